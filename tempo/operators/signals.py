"""The signal table: tuned score, truth gate, policy and the facts a message states."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempo.functions.windows import o, rolling_rank, share_above_today
from tempo.operators.features import BLOCKED
from tempo.operators.policy import PolicyConfig, apply_policy
from tempo.operators.tuning import SPANS, TuningConfig, calibrated, zscore_candidates
from tempo.sources.panel import latest_quotes

# What a signal is called and its columns.
INDICATOR, SCENARIO = "zscore_tuned", "favourable_now"
COLUMNS = ("signal_date", "iso", "indicator", "direction", "strength", "strength_pct", "speed", "scenario", "window", "rub_per_unit", "level_percentile", "deviation_pct", "message")


@dataclass(frozen=True)
class SignalConfig:
    spans: tuple[int, ...] = SPANS
    tuning: TuningConfig = field(default_factory=TuningConfig)
    policy: PolicyConfig = field(default_factory=lambda: PolicyConfig(cooldown_observations=1))
    level_window: int = 90
    require_true_fact: bool = True

    def gated_policy(self) -> PolicyConfig:
        if not self.require_true_fact:
            return self.policy
        return replace(self.policy, minimum_score=BLOCKED / 2)


def speed_of(label: Column) -> Column:
    span = F.try_element_at(F.split(label, "="), F.lit(2)).try_cast("int")
    return F.when(span <= 10, "fast").when(span <= 60, "medium").when(span.isNotNull(), "slow").otherwise("unknown")


def tuned_scores(panel: DataFrame, config: SignalConfig = SignalConfig()) -> DataFrame:
    """Tuned z-scores with the chosen span and the deviation from that span's mean; gated where asked for."""
    names = [f"span={s}" for s in config.spans]
    tuned = calibrated(zscore_candidates(panel, config.spans), names, config.tuning)
    deviation = F.coalesce(*[F.when(F.col("chosen") == f"span={s}", F.col(f"dev_{s}")) for s in config.spans])
    tuned = tuned.withColumn("deviation_pct", deviation).drop(*[f"dev_{s}" for s in config.spans])
    if config.require_true_fact:
        tuned = tuned.withColumn("score", F.when(F.col("deviation_pct") < 0, F.col("score")).otherwise(BLOCKED))
    return tuned


def message(iso: Column, deviation: Column, label: Column) -> Column:
    """The fixed sentence a signal carries: how far the rate is below its mean, with a decimal comma."""
    percent = F.replace(F.format_string("%.1f", F.abs(deviation)), F.lit("."), F.lit(","))
    span = F.try_element_at(F.split(label, "="), F.lit(2))
    text = F.concat(F.lit("Курс "), iso, F.lit(" сейчас на "), percent, F.lit("% ниже своего среднего за последние "), span, F.lit(" наблюдений."))
    return F.when((deviation < 0) & span.isNotNull(), text).otherwise("")


def signal_table(panel: DataFrame, config: SignalConfig = SignalConfig()) -> DataFrame:
    """One row per emitted signal, described by what was known on its date."""
    scores = tuned_scores(panel, config)
    decided = apply_policy(scores.select("quote_date", "available_on", "iso", "rub_per_unit", "score", "chosen", "deviation_pct"), config.gated_policy())
    decided = decided.withColumn("strength_pct", rolling_rank("score", config.policy.threshold_lookback, 20))
    facts = panel.select("iso", "quote_date", (F.col("rub_per_unit") / F.lag("rub_per_unit", 5).over(o()) - 1).alias("ret"), share_above_today("rub_per_unit", config.level_window, 20).alias("level_percentile"))
    sent = decided.filter("decision").join(facts, ["iso", "quote_date"], "left")
    return sent.select(
        F.col("quote_date").alias("signal_date"), "iso", F.lit(INDICATOR).alias("indicator"), F.when(F.col("ret") < 0, "down").otherwise("up").alias("direction"),
        F.col("score").alias("strength"), "strength_pct", speed_of(F.col("chosen")).alias("speed"), F.lit(SCENARIO).alias("scenario"), F.col("chosen").alias("window"),
        "rub_per_unit", "level_percentile", "deviation_pct", message(F.col("iso"), F.col("deviation_pct"), F.col("chosen")).alias("message"),
    )


def signals_asof(panel: DataFrame, asof: str, config: SignalConfig = SignalConfig()) -> DataFrame:
    """The table as it stood on a date: only quotes usable by then are read."""
    return signal_table(panel.filter(F.col("available_on") <= F.lit(asof).cast("date")), config)


def latest_signal(panel: DataFrame, asof: str, config: SignalConfig = SignalConfig()) -> DataFrame:
    """The signals decided exactly on a date; a series on hold has no row."""
    lag = panel.select("iso", F.col("quote_date").alias("signal_date"), "available_on")
    return signals_asof(panel, asof, config).join(lag, ["iso", "signal_date"]).filter(F.col("available_on") == F.lit(asof).cast("date")).drop("available_on")


def freshness(signals: DataFrame, panel: DataFrame, asof: str, threshold_bps: float | DataFrame = 50.0) -> DataFrame:
    """How far the last usable quote has moved from each signal's: same (at most 0.5 bps), better, mild or stale."""
    now = latest_quotes(panel, asof).select("iso", F.col("rub_per_unit").alias("rate_now"))
    moved = signals.filter(F.col("signal_date") <= F.lit(asof).cast("date")).join(now, "iso").withColumn("delta_bps", (F.col("rate_now") / F.col("rub_per_unit") - 1) * 10_000)
    moved = moved.withColumn("limit_bps", F.lit(float(threshold_bps))) if not isinstance(threshold_bps, DataFrame) else moved.join(threshold_bps, "iso", "left").withColumn("limit_bps", F.coalesce("limit_bps", F.lit(50.0)))
    d = F.col("delta_bps")
    level = F.when(F.abs(d) <= 0.5, "same").when(d < 0, "better").when(d <= F.col("limit_bps"), "mild").otherwise("stale")
    return moved.select("iso", "signal_date", "rate_now", "delta_bps", level.alias("level"))


def disclosure_threshold(panel: DataFrame) -> DataFrame:
    """limit_bps per series: the median absolute daily move, 50 where there is none."""
    moves = panel.withColumn("m", F.abs(F.col("rub_per_unit") / F.lag("rub_per_unit").over(o()) - 1) * 10_000)
    return moves.groupBy("iso").agg(F.coalesce(F.expr("percentile(m, 0.5)"), F.lit(50.0)).alias("limit_bps"))

"""Policy backtest: decisions joined with outcomes, matched random schedules and a report per series and in total."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempo.functions.windows import one_row_each
from tempo.operators import stats
from tempo.operators.labels import build_outcomes
from tempo.operators.policy import PolicyConfig, apply_policy, check_scores


@dataclass(frozen=True)
class BacktestConfig:
    policy: PolicyConfig = PolicyConfig(minimum_score=0.5)
    horizon: int = 20
    epsilon_bps: float = 30.0
    random_trials: int = 200
    bootstrap_trials: int = 1000
    seed: int = 0


def baseline_scores(features: DataFrame) -> DataFrame:
    """Mean of how low the residual and the level rank."""
    score = ((1 - F.col("residual_pct")) + (1 - F.col("pct_rank_90"))) / 2
    return features.select("quote_date", "available_on", "iso", "rub_per_unit", score.alias("score"))


def outcome_statistics() -> list[Column]:
    a = F.col("advantage_bps")
    return [
        F.avg(a).alias("mean_advantage_bps"), F.expr("percentile(advantage_bps, 0.5)").alias("median_advantage_bps"), F.expr("percentile(advantage_bps, 0.1D)").alias("p10_advantage_bps"),
        F.avg((a > 0).cast("double")).alias("hit_rate"), F.avg((a < 0).cast("double")).alias("negative_share"), F.avg(F.col("early_send").cast("double")).alias("early_send_rate"),
        F.expr("percentile(regret_bps, 0.9D)").alias("p90_regret_bps"),
    ]


def with_total(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Per series and over all series as ``ALL``; ``keys`` group besides."""
    columns = [F.col(k) for k in keys]
    return df.groupingSets([[*columns, F.col("iso")], columns], *columns, F.col("iso")).agg(*aggregates).withColumn("iso", F.coalesce("iso", F.lit("ALL")))


def decisions_with_outcomes(panel: DataFrame, scores: DataFrame, config: BacktestConfig) -> DataFrame:
    """The policy's log with outcomes; it fails when it runs if a series has a day twice in the panel or the scores."""
    outcomes = build_outcomes(one_row_each(panel, ["iso", "quote_date"], "panel"), config.horizon, config.epsilon_bps).select("iso", "quote_date", "advantage_bps", "early_send", "regret_bps", "outcome_complete")
    check_scores(scores)
    log = apply_policy(one_row_each(scores, ["iso", "quote_date"], "scores"), config.policy).join(outcomes, ["iso", "quote_date"], "left")
    return log.withColumn("outcome_complete", F.coalesce("outcome_complete", F.lit(False)))


def report(log: DataFrame, config: BacktestConfig) -> DataFrame:
    """The table of results; an unmatched total has no row of its own."""
    done = log.filter("outcome_complete")
    sent = done.filter("decision")
    model = with_total(sent, [], [F.count(F.lit(1)).alias("n_signals"), *outcome_statistics()])
    weeks = with_total(done, [], [(F.count(F.lit(1)) / 5.0).alias("weeks")])
    gap = F.col("observation_position") - F.lag("observation_position").over(Window.partitionBy("iso").orderBy("observation_position"))
    series = with_total(sent.withColumn("gap", gap), [], [(F.count_if(F.col("gap") <= 5) / F.count(F.lit(1))).alias("series_share")])
    drawn = stats.matched_random_schedules(done.select("iso", "quote_date", "window_id", "decision", "advantage_bps", "early_send", "regret_bps"), config.random_trials, config.seed)
    trial = with_total(drawn, ["trial"], outcome_statistics())
    rand = trial.groupBy("iso").agg(F.avg("mean_advantage_bps").alias("random_mean_advantage_bps"), F.avg("hit_rate").alias("random_hit_rate"))
    keyed = sent.withColumn("_o", F.concat_ws("|", "iso", "quote_date"))
    ci = stats.block_bootstrap(keyed.unionByName(keyed.withColumn("iso", F.lit("ALL"))), ["iso"], "advantage_bps", "_o", config.horizon, config.bootstrap_trials, config.seed)
    ci = ci.withColumnsRenamed({"ci_low": "advantage_ci_low", "ci_high": "advantage_ci_high"})
    out = weeks.join(model, "iso", "left").join(series, "iso", "left").join(rand, "iso", "left").join(ci, "iso", "left")
    lift = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns({
        "n_signals": F.coalesce("n_signals", F.lit(0)), "per_week": F.try_divide(F.coalesce("n_signals", F.lit(0)), F.col("weeks")),
        "advantage_delta_bps": F.col("mean_advantage_bps") - F.col("random_mean_advantage_bps"),
        "advantage_lift": lift("mean_advantage_bps", "random_mean_advantage_bps"), "hit_rate_lift": lift("hit_rate", "random_hit_rate"),
    }).drop("weeks")


def run_backtest(panel: DataFrame, scores: DataFrame, config: BacktestConfig = BacktestConfig()) -> tuple[DataFrame, DataFrame]:
    """(decision log, report); outcomes are attached after all decisions are made."""
    log = decisions_with_outcomes(panel, scores, config)
    return log, report(log, config)

"""Calls that a service or a command line makes, each a small lazy DataFrame over the panel."""

from __future__ import annotations

import argparse
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempo.functions.storage import cut_lineage
from tempo.operators import backtest, benchmark, features, models, signals, stand, stats
from tempo.operators import evaluation as E
from tempo.operators import indicators as I
from tempo.operators.labels import build_labels
from tempo.operators.models import walk_forward_ridge
from tempo.operators.policy import PolicyConfig
from tempo.sources import panel as N
from tempo.sources import sinks


class RateNotFoundError(LookupError):
    """There is no such currency, or no quote of it that could be used."""


@dataclass(frozen=True)
class Settings:
    """Where a service finds its rates: the setting tempo.rates.dir of the session, else the variable TEMPO_RATES_DIR."""

    rates_dir: str

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        return cls(spark.conf.get("tempo.rates.dir", None) or os.environ.get("TEMPO_RATES_DIR") or "currency_data")


@dataclass(frozen=True)
class BacktestRequest:
    """What a client may ask of a backtest; anything outside the bounds is a ValueError."""

    corridors: tuple[str, ...]
    source: str = "live"
    as_of: str = "9999-12-31"
    horizon: int = 20
    epsilon_bps: float = 30.0
    window: str = "week"
    max_signals_per_window: int = 2
    cooldown_observations: int = 3
    min_train: int = 500
    random_trials: int = 200
    bootstrap_trials: int = 1000
    seed: int = 0

    def __post_init__(self):
        codes = tuple(c.strip().upper() for c in self.corridors)
        bounds = {"horizon": (1, 60), "epsilon_bps": (0, 1000), "max_signals_per_window": (1, 10), "cooldown_observations": (0, 60), "min_train": (50, 10**9), "random_trials": (10, 1000), "bootstrap_trials": (100, 5000)}
        wrong = [f"{name} {low}..{high}" for name, (low, high) in bounds.items() if not low <= getattr(self, name) <= high]
        if self.source not in ("live", "baseline", "ridge"):
            wrong.append("source live, baseline or ridge")
        if self.window not in ("week", "month"):
            wrong.append("window week or month")
        if not 1 <= len(codes) <= 5 or len(set(codes)) < len(codes) or not all(re.fullmatch("[A-Z]{3}", c) for c in codes):
            wrong.append("one to five different corridors of three letters")
        if wrong:
            raise ValueError("; ".join(wrong))
        object.__setattr__(self, "corridors", codes)


def register_views(panel: DataFrame, usd: DataFrame | None = None) -> None:
    """Panel, features and labels as temporary views, so that Spark SQL works on them."""
    panel.createOrReplaceTempView("panel")
    features.compute_features(panel, usd).createOrReplaceTempView("features")
    build_labels(panel).createOrReplaceTempView("labels")


def latest_rate(panel: DataFrame, iso: str, as_of: str) -> DataFrame:
    """The last usable quote; no row where there is none."""
    return N.latest_quotes(panel.filter(F.col("iso") == iso.strip().upper()), as_of)


def history(panel: DataFrame, iso: str) -> DataFrame:
    return panel.filter(F.col("iso") == iso.strip().upper()).select("quote_date", "available_on", "rub_per_unit")


def currency(iso: str) -> str:
    code = iso.strip().upper()
    if not re.fullmatch("[A-Z]{3}", code):
        raise RateNotFoundError(f"{iso!r} is no currency code")
    return code


def evaluate(panel: DataFrame, iso: str, as_of: str, config: signals.SignalConfig = signals.SignalConfig()) -> DataFrame:
    """One row: status ``candidate`` where a signal is decided on the date, else ``hold``, with facts and the reason.

    RateNotFoundError for what is no currency code, or has no usable quote on the date.
    """
    wanted = currency(iso)
    known = latest_rate(panel, wanted, as_of).select("iso", "quote_date", "available_on", F.col("rub_per_unit").alias("rate"))
    if known.isEmpty():
        raise RateNotFoundError(f"no quote of {wanted} could be used on {as_of}")
    facts = ("indicator", "direction", "speed", "scenario", "window", "strength", "strength_pct", "deviation_pct", "level_percentile", "message")
    sent = signals.latest_signal(panel.filter(F.col("iso") == wanted), as_of, config).select("iso", "signal_date", *facts)
    candidate = F.col("signal_date").isNotNull()
    why = F.format_string("%.1f%% below its mean over %s; stronger than %.0f%% of its past scores", F.abs("deviation_pct"), F.col("window"), F.coalesce("strength_pct", F.lit(0.0)) * 100)
    held = "not selected: not below the mean it is measured by, or the budget of the week is better spent on another day"
    return known.join(sent, "iso", "left").withColumns({"status": F.when(candidate, "candidate").otherwise("hold"), "reason": F.when(candidate, why).otherwise(held)})


def health(panel: DataFrame, wanted: list[str]) -> DataFrame:
    """The quotes at hand per series with ``status``: degraded where one that is wanted has none, else ok."""
    held = N.readiness(panel)
    lost = N.unknown_sources(panel, wanted).select("iso", F.lit(0).cast("long").alias("n_quotes"), F.lit(None).cast("date").alias("available_until"))
    return held.unionByName(lost).withColumn("status", F.when(F.col("n_quotes") > 0, "ok").otherwise("degraded"))


def signal_payloads(panel: DataFrame, config: signals.SignalConfig = signals.SignalConfig()) -> DataFrame:
    """Signals as a client sees them: the currency's name in place of its code, once; no number that JSON lacks."""
    rows = N.with_names(signals.signal_table(panel, config))
    return rows.withColumns({"client_message": stand.client_message(), **{c: sinks.finite(F.round(c, n)) for c, n in (("rub_per_unit", 6), ("deviation_pct", 3), ("strength_pct", 4))}})


def run_backtest(panel: DataFrame, usd: DataFrame | None, request: BacktestRequest) -> tuple[DataFrame, DataFrame]:
    """(decision log, report) of the tuned and gated score that is shipped, the baseline or the ridge.

    ``usd`` is the USD series, from the panel itself unless given. RateNotFoundError if a corridor has no usable quote.
    """
    usd = panel.filter("iso = 'USD'") if usd is None else usd
    known = N.as_of(panel, request.as_of).filter(F.col("iso").isin(*request.corridors))
    lost = [r["iso"] for r in N.unknown_sources(known, request.corridors).collect()]  # five at most
    if lost:
        raise RateNotFoundError(f"no usable quotes of {', '.join(sorted(lost))}")
    if request.source == "live":
        scores = signals.tuned_scores(known).select("quote_date", "available_on", "iso", "rub_per_unit", "score")
    else:
        built = features.compute_features(known, N.as_of(usd, request.as_of))
        baseline = request.source == "baseline"
        scores = backtest.baseline_scores(built) if baseline else walk_forward_ridge(built, known, request.horizon, min_train=request.min_train).withColumnRenamed("prediction", "score")
    floor = {"live": features.BLOCKED / 2, "baseline": 0.5, "ridge": 0.0}[request.source]
    rule = PolicyConfig(request.window, request.max_signals_per_window, request.cooldown_observations, minimum_score=floor)
    return backtest.run_backtest(known, scores, backtest.BacktestConfig(rule, request.horizon, request.epsilon_bps, request.random_trials, request.bootstrap_trials, request.seed))


def ridge_on(predictions: DataFrame, snapshots: DataFrame, built: DataFrame, panel: DataFrame, iso: str, date: str, slots_per_week: float = 1.5) -> DataFrame:
    """One row: the ridge's answer on a date and whether it sends, from stored predictions and sums.

    The prediction comes from the last stored sums; predictions before it are read, not fitted, to rank it.
    """
    code = currency(iso)
    mine = lambda rows: rows.filter(F.col("iso") == code)
    now = models.ridge_asof(mine(snapshots), mine(built), mine(panel), date)
    columns = ("quote_date", "available_on", "iso", "rub_per_unit", "prediction")
    past = mine(predictions).join(now.select("iso", F.col("quote_date").alias("_end")), "iso").filter("quote_date < _end").select(*columns)
    sent = I.model_ridge(past.unionByName(now.select(*columns)), slots_per_week).select("iso", F.col("signal_date").alias("quote_date"), F.lit(True).alias("sent"))
    return now.join(sent, ["iso", "quote_date"], "left").withColumn("sent", F.coalesce("sent", F.lit(False)))


def scorecard(board: DataFrame, gates: DataFrame) -> str:
    """Markdown of the leaderboard and the gate matrix: a few rows per strategy."""
    wide = board.join(benchmark.gate_verdicts(gates).select("strategy", "n_passed", "failed"), "strategy")
    rows = wide.orderBy(F.desc_nulls_last("cbsb_score")).select("strategy", "n_signals", F.round("cbsb_score", 1), F.round("currency_uplift_bps", 1), F.round("hit_lift", 3), F.round("p_value", 3), F.round("per_week", 2), "n_passed", "failed").collect()
    head = ("strategy", "signals", "score", "uplift bps", "lift", "p", "per week", "gates", "failed")
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def main(argv: list[str] | None = None) -> None:
    """spark-submit tempo/plans/service.py COMMAND RATES_DIR OUT [--as-of DATE] [--source live|baseline|ridge] [--iso CODE]

    COMMAND: signals, benchmark, backtest, indicators, ridge (predictions, their signals, hit rates, rhythm and sums),
    ridge-on (the answer for --iso on --as-of from what ridge left in OUT), stand (the day log and the export),
    rates (the validated panel, written so that it can be read as RATES_DIR again). RATES_DIR may be ``-``: the setting.
    """
    args = argparse.ArgumentParser(description=main.__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("command", choices=("signals", "benchmark", "backtest", "indicators", "ridge", "ridge-on", "stand", "rates"))
    args.add_argument("rates")
    args.add_argument("out")
    args.add_argument("--as-of", default="9999-12-31")
    args.add_argument("--source", default="live", choices=("live", "baseline", "ridge"))
    args.add_argument("--iso", default="USD")
    given = args.parse_args(argv)
    spark = SparkSession.builder.appName("tempo").getOrCreate()
    rates = Settings.of(spark).rates_dir if given.rates == "-" else given.rates
    panel = cut_lineage(N.as_of(N.read_rate_directory(spark, rates), given.as_of))
    tables = {}
    if given.command == "signals":
        tables = {"signals": signals.signal_table(panel)}
    elif given.command == "rates":
        sinks.write_rates(panel, given.out)
    elif given.command == "backtest":
        series = tuple(r["iso"] for r in panel.select("iso").filter("iso <> 'USD'").distinct().orderBy("iso").limit(5).collect())
        log, report = run_backtest(panel, None, BacktestRequest(series, given.source, given.as_of))
        drawn = stats.matched_random_schedules(log.filter("outcome_complete").select("iso", "quote_date", "window_id", "decision"), backtest.BacktestConfig().random_trials, backtest.BacktestConfig().seed)
        sinks.write_backtest(log.drop("thresholds"), drawn, report, given.out)
    elif given.command == "indicators":
        matrix, cost = E.indicator_matrix(panel, walk_forward_ridge(features.compute_features(panel), panel))
        tables = {"indicators_matrix": matrix, "waiting_cost": cost}
    elif given.command == "ridge-on":
        held = {n: sinks.read_artefact(spark, given.out, n) for n in ("predictions", "snapshots", "features")}
        ridge_on(held["predictions"], held["snapshots"], held["features"], panel, given.iso, given.as_of).show(truncate=False)
    elif given.command == "stand":
        sent = cut_lineage(signals.signal_table(panel))
        start = str(panel.agg(F.add_months(F.max("quote_date"), -12)).first()[0])
        stand.store_days(stand.day_log(panel, sent, start), f"{given.out.rstrip('/')}/days")
        stand.write_export(stand.export_pieces(panel, sent, start, start, [str(panel.agg(F.max("quote_date")).first()[0])]), f"{given.out.rstrip('/')}/export")
        tables = {"corridors": stand.corridors(panel, sent, start, start)}
    elif given.command == "ridge":
        built = features.compute_features(panel)
        predicted = cut_lineage(walk_forward_ridge(built, panel))
        sinks.write_artefacts({"snapshots": models.ridge_snapshots(built, panel), "features": built}, given.out, "parquet")
        events = I.model_ridge(predicted)
        matrix = I.metric_matrix(panel, events, scenario="window_closing")
        tables = {"predictions": predicted, "signals": events, "metrics": matrix, "frequency": benchmark.frequency(events, panel), "summary": E.metric_summary(matrix)}
    else:
        result = benchmark.run_benchmark(panel, names=list(benchmark.STRATEGIES))
        spec, config, built = benchmark.BenchmarkSpec(), models.UtilityRiskConfig(), features.compute_features(panel)
        swept, days = benchmark.swept_strategies(list(benchmark.STRATEGIES)), benchmark.evaluated_days(panel, spec)
        coefficients = models.walk_forward_coefficients(models.heads_data(panel, built, config), config)
        tables = {
            "leaderboard": result.leaderboard, "per_corridor": result.corridors, "per_fold": result.cells, "gates": result.gates, "horizons": result.horizons, "null_distribution": result.null,
            "signals": result.signals, "cadence_sweep": benchmark.cadence_sweep(benchmark.build_scores(panel, swept, built), swept, days),
            "lambda_sweep": benchmark.lambda_sweep(models.walk_forward_heads(panel, built), days, spec.policy), "audit": benchmark.audit_no_lookahead(panel, None, benchmark.score_builders(spec)),
            "coefficients": coefficients.withColumns({c: F.to_json(c) for c in ("u", "m", "b")}),
        }
        spark.createDataFrame([(scorecard(result.leaderboard, result.gates),)], "value string").coalesce(1).write.mode("overwrite").text(f"{given.out.rstrip('/')}/scorecard")
    sinks.write_artefacts(tables, given.out)


if __name__ == "__main__":
    main()

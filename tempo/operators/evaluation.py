"""One indicator as a whole: its money, its truthfulness under both hit rules, its rhythm, and the choice of its parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempo.functions.storage import cut_lineage
from tempo.functions.windows import o
from tempo.operators import indicators as I
from tempo.operators.simulate import budgets, regular_days, simulate, uplift

V = "rub_per_unit"


def own_scenario(indicator: str) -> str:
    """The hit rule that fits what an indicator says: slow ones and models warn that a window closes."""
    return "window_closing" if I.SPEED[indicator] in ("slow", "model") else "favourable_now"


def hit_table(panel: DataFrame, events: DataFrame, horizons: Sequence[int] = (5, 15)) -> DataFrame:
    """indicator, iso, and per horizon and rule hit_<rule>_h<h> and lift_<rule>_h<h> of events (indicator, iso, signal_date).

    The four or more flags of a day are worked out once; lifts compare with the series' days that have a full horizon.
    """
    rules = ("favourable_now", "window_closing")
    w = Window.partitionBy("iso")
    days = panel.withColumns({"_at": F.row_number().over(o()), "_n": F.count(F.lit(1)).over(w)} | {f"{rule}_h{h}": I.held(h)[rule].cast("double") for h in horizons for rule in rules})
    flags = [f"{rule}_h{h}" for h in horizons for rule in rules]
    base = days.groupBy("iso").agg(*[F.avg(F.when(F.col("_at") <= F.col("_n") - int(c.rsplit("_h", 1)[1]), F.col(c))).alias(f"base_{c}") for c in flags])
    marks = days.select("iso", F.col("quote_date").alias("signal_date"), *flags)
    own = events.join(marks, ["iso", "signal_date"]).groupBy("indicator", "iso").agg(*[F.avg(c).alias(f"hit_{c}") for c in flags])
    lifts = [F.when(F.col(f"base_{c}") > 0, F.col(f"hit_{c}") / F.col(f"base_{c}")).alias(f"lift_{c}") for c in flags]
    return own.join(base, "iso").select("indicator", "iso", *[f"hit_{c}" for c in flags], *lifts)


def evaluate_events(panel: DataFrame, events: DataFrame, bounds: DataFrame, trials: int = 500) -> DataFrame:
    """A row per indicator and series of ``bounds`` (iso, start, end): signals, uplifts, hit rates and lifts, rhythm.

    ``events`` holds indicator, iso, signal_date and the rate. Every series is bought and counted within its own bounds,
    all indicators in one plan; lifts compare with random days of the whole panel, and a signal near the end is judged by
    the quotes that follow it.
    """
    names = [F.lit(n) for n in I.SPEED]
    inside = lambda rows, date: rows.join(bounds, "iso").filter(F.col(date).between(F.col("start"), F.col("end"))).drop("start", "end")
    sent, days = inside(events, "signal_date"), inside(panel, "quote_date")
    series = F.concat_ws("|", "indicator", "iso")
    keyed = days.withColumn("indicator", F.explode(F.array(*names))).withColumn("iso", series).drop("indicator")
    money = uplift(simulate(keyed, sent.withColumn("iso", series).drop("indicator"), trials=trials))
    money = money.select(F.substring_index("iso", "|", 1).alias("indicator"), F.substring_index("iso", "|", -1).alias("iso"), "uplift_vs_dca", "uplift_vs_random")
    gap = F.date_diff("signal_date", F.lag("signal_date").over(Window.partitionBy("indicator", "iso").orderBy("signal_date")))
    rhythm = sent.withColumn("_gap", gap).groupBy("indicator", "iso").agg(F.count(F.lit(1)).alias("n_signals"), (F.count_if(F.col("_gap") <= 5) / F.count(F.lit(1))).alias("series_share"))
    size = days.groupBy("iso").agg(F.countDistinct("quote_date").alias("_days"))
    named = bounds.select("iso", F.explode(F.array(*names)).alias("indicator"))
    speed = F.create_map(*[F.lit(x) for pair in I.SPEED.items() for x in pair])[F.col("indicator")]
    closing = F.col("indicator").isin([n for n in I.SPEED if own_scenario(n) == "window_closing"])
    pick = lambda c, own: F.when(closing == own, F.col(c.replace("*", "window_closing"))).otherwise(F.col(c.replace("*", "favourable_now")))
    keys = ["indicator", "iso"]
    out = named.join(size, "iso", "left").join(rhythm, keys, "left").join(money, keys, "left").join(hit_table(panel, sent), keys, "left")
    return out.select(
        *keys, speed.alias("speed"), F.when(closing, "window_closing").otherwise("favourable_now").alias("scenario"), F.coalesce("n_signals", F.lit(0).cast("long")).alias("n_signals"), "uplift_vs_dca", "uplift_vs_random",
        pick("lift_*_h5", True).alias("lift_h5"), pick("lift_*_h5", False).alias("lift_h5_other"), pick("hit_*_h5", True).alias("hit_rate_h5"), pick("hit_*_h15", True).alias("hit_rate_h15"),
        (F.col("n_signals") / (F.col("_days") / 5.0)).alias("per_week"), "series_share",
    )


def trailing_bounds(panel: DataFrame, months: int = 12) -> DataFrame:
    """iso, start, end: the last months up to the panel's last quote, the same for all series."""
    last = panel.agg(F.max("quote_date").alias("end"))
    return panel.select("iso").distinct().crossJoin(last).select("iso", F.add_months("end", -months).alias("start"), "end")  # one row of bounds


def calibrated_events(panel: DataFrame, predictions: DataFrame | None = None, grids: Mapping[str, Mapping[str, Sequence[float]]] = I.GRIDS) -> tuple[DataFrame, DataFrame]:
    """(events, parameters): signals of every indicator with the parameters that calibration chose for each series.

    A series without a choice takes the first of the grid. ``predictions`` add the model, which has no parameters.
    """
    first = F.create_map(*[F.lit(x) for name, grid in grids.items() for x in (name, I.key_of(I.parameter_sets(grid)[0]))])
    chosen = calibrate_indicators(panel, grids).select("indicator", "iso", "params")
    named = panel.select("iso").distinct().select("iso", F.explode(F.array(*[F.lit(n) for n in grids])).alias("indicator")).join(chosen, ["indicator", "iso"], "left")
    named = named.withColumn("params", F.coalesce("params", first[F.col("indicator")]))
    events = I.all_events(panel, grids).join(named, ["indicator", "iso", "params"]).select("indicator", "iso", "signal_date", V)
    if predictions is not None:
        events = events.unionByName(I.model_ridge(predictions).select(F.lit("model_ridge").alias("indicator"), "iso", "signal_date", V))
    return events, named


def indicator_matrix(panel: DataFrame, predictions: DataFrame | None = None, trials: int = 500, months: int = 12) -> tuple[DataFrame, DataFrame]:
    """(matrix, waiting cost): every indicator and series over the trailing year with verdict and reason, and what it costs
    to wait from the calibrated fast signal for the calibrated slow one."""
    events, named = calibrated_events(panel, predictions)
    events, named = cut_lineage(events), cut_lineage(named)
    scored = evaluate_events(panel, events, trailing_bounds(panel, months), trials)
    if predictions is None:
        scored = scored.filter("indicator <> 'model_ridge'")
    matrix = I.verdicts(scored.join(named, ["indicator", "iso"], "left").withColumn("params", F.coalesce("params", F.lit(""))))
    cost = I.waiting_cost(panel, events.filter("indicator = 'value'"), events.filter("indicator = 'reversal_from_min'"))
    return matrix, cost.select("iso", F.lit("value").alias("fast"), F.lit("reversal_from_min").alias("slow"), "n_pairs", F.col("median_bps").alias("waiting_cost_bps"))


def fold_starts(panel: DataFrame, folds: int = 4, months: int = 6) -> DataFrame:
    """iso, fold, fold_start: the last 6, 12, 18 and 24 months of each series, those that begin after it does."""
    ends = panel.groupBy("iso").agg(F.max("quote_date").alias("last"), F.min("quote_date").alias("first"))
    each = ends.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("fold_start", F.add_months("last", -months * (F.col("fold") + 1)))
    return each.filter("first < fold_start").select("iso", "fold", "fold_start")


def fold_uplifts(panel: DataFrame, grids: Mapping[str, Mapping[str, Sequence[float]]] = I.GRIDS, folds: int = 4) -> DataFrame:
    """indicator, iso, params, turn (place in the grid), fold, uplift over a regular pace in percent.

    Budgets and the regular pace are worked out once per fold, the events of all parameters against them. Parameters
    without a signal in a fold buy nothing there.
    """
    starts = fold_starts(panel, folds)
    sets = [(name, turn, given) for name, grid in grids.items() for turn, given in enumerate(I.parameter_sets(grid))]
    events = I.all_events(panel, grids)
    tried = panel.sparkSession.createDataFrame([(name, turn, I.key_of(given)) for name, turn, given in sets], "indicator string, turn int, params string")
    key = F.concat_ws("|", "iso", "fold")
    days = panel.join(F.broadcast(starts), "iso").filter("quote_date >= fold_start").withColumn("iso", key)  # a few rows per series
    regular = regular_days(days)
    paced = regular.groupBy("iso").agg(F.sum(1 / F.col(V)).alias("per_rouble"), F.count(F.lit(1)).alias("n"))
    held = budgets(days).join(paced, "iso").select(F.col("iso").alias("key"), "total", (F.col("total") / F.col("n") * F.col("per_rouble")).alias("paced"))
    sent = events.join(F.broadcast(starts), "iso").filter("signal_date >= fold_start").groupBy("indicator", "turn", key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.col(V)).alias("per_rouble"))
    each = starts.select("iso", "fold", key.alias("key")).join(held, "key").crossJoin(F.broadcast(tried)).join(sent, ["indicator", "turn", "key"], "left")
    bought = F.coalesce(F.col("total") / F.col("n") * F.col("per_rouble"), F.lit(0.0))
    return each.select("indicator", "iso", "params", "turn", "fold", F.round((bought - F.col("paced")) / F.col("paced") * 100, 9).alias("uplift"))


def calibrate_indicators(panel: DataFrame, grids: Mapping[str, Mapping[str, Sequence[float]]] = I.GRIDS, folds: int = 4) -> DataFrame:
    """The parameters of each indicator and series by ``I.calibrate`` over trailing folds."""
    return I.calibrate(fold_uplifts(panel, grids, folds))


def trailing_year(panel: DataFrame, events: DataFrame, months: int = 12) -> DataFrame:
    """Each quote of a series' last year with whether a signal fell on it and whether a regular pace would have bought."""
    since = panel.groupBy("iso").agg(F.add_months(F.max("quote_date"), -months).alias("since"))
    days = panel.join(since, "iso").filter("quote_date >= since").select("iso", "quote_date", V).withColumn("at", F.row_number().over(o()) - 1)
    marks = events.select("iso", F.col("signal_date").alias("quote_date"), F.lit(True).alias("is_signal")).distinct()
    return days.join(marks, ["iso", "quote_date"], "left").select("iso", "quote_date", V, F.coalesce("is_signal", F.lit(False)).alias("is_signal"), (F.col("at") % 5 == 0).alias("is_regular"))


def corridor_summary(panel: DataFrame, events: DataFrame, trials: int = 500, months: int = 12) -> DataFrame:
    """One row per series and way of buying over its last year, with the hit rates of all its signals at 5 and 15 quotes."""
    since = panel.groupBy("iso").agg(F.add_months(F.max("quote_date"), -months).alias("since"))
    days = panel.join(since, "iso").filter("quote_date >= since").drop("since")
    sent = events.join(since, "iso").filter("signal_date >= since").drop("since")
    parts = [I.hit_rates(panel, events, h, "window_closing").select("iso", "n_signals", F.col("hit_rate").alias(f"hit_rate_h{h}")) for h in (5, 15)]
    return simulate(days, sent, trials=trials).join(parts[0].join(parts[1].drop("n_signals"), "iso"), "iso", "left")


def metric_summary(matrix: DataFrame) -> DataFrame:
    """Means of the metrics over the horizons of each series, to three digits."""
    return matrix.groupBy("iso").agg(*[F.round(F.avg(c), 3).alias(c) for c in ("hit_rate", "lift", "advantage_bps")])

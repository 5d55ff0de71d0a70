"""Realised outcomes of every observation: the only look-ahead, each stamped with the date it was known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempo.functions.windows import o

V = "rub_per_unit"
BPS = 10_000.0


def _middle(frame) -> Column:
    return F.expr(f"percentile({V}, 0.5)").over(frame)


def build_labels(panel: DataFrame, horizon: int = 10, execution_offset: int = 1, epsilon_bps: float = 0.0, bad_push_bps: float = 100.0, local_min_tolerance_bps: float = 10.0) -> DataFrame:
    """The panel with execution, advantages, regret, flags, maturity and completeness.

    Values are null and flags false unless the whole forward window is there; the centred ones also need as many
    observations before execution.
    """
    if horizon <= 0 or execution_offset < 0:
        raise ValueError("horizon must be positive and execution_offset not negative")
    e, h = execution_offset, horizon
    ahead, around = o().rowsBetween(e + 1, e + h), o().rowsBetween(e - h, e + h)
    df = panel.withColumns({
        "x": F.lead(V, e).over(o()), "x_date": F.lead("quote_date", e).over(o()), "known": F.lead("available_on", e + h).over(o()),
        "n_ahead": F.count(V).over(ahead), "mean_ahead": F.avg(V).over(ahead), "median_ahead": _middle(ahead), "min_ahead": F.min(V).over(ahead),
        "max_ahead": F.max(V).over(ahead), "n_around": F.count(V).over(around), "mean_around": F.avg(V).over(around), "min_around": F.min(V).over(around),
        "buys_around": F.avg(1.0 / F.col(V)).over(around),
    })
    full, centred, x = F.col("n_ahead") == h, (F.col("n_ahead") == h) & (F.col("n_around") == 2 * h + 1), F.col("x")
    bound = x * (1.0 + epsilon_bps / BPS)
    advantage = (F.col("mean_ahead") - x) / x * BPS
    flag = lambda when, c: F.coalesce(when & c, F.lit(False))
    return df.select(
        *panel.columns,
        F.when(full, F.col("x_date")).alias("exec_date"),
        F.when(full, x).alias("exec_rate"),
        F.when(full, advantage).alias("fwd_advantage_bps"),
        F.when(full, (F.col("median_ahead") - x) / x * BPS).alias("fwd_median_advantage_bps"),
        F.when(centred, (F.col("mean_around") - x) / x * BPS).alias("window_advantage_bps"),
        F.when(centred, ((1.0 / x) / F.col("buys_around") - 1.0) * BPS).alias("currency_gain_bps"),
        F.when(full, F.greatest(F.lit(0.0), -advantage)).alias("adverse_bps"),
        F.when(full, F.greatest(F.lit(0.0), (x - F.col("min_ahead")) / x * BPS)).alias("regret_bps"),
        flag(full, advantage < -bad_push_bps).alias("bad_push"),
        flag(centred, F.col("min_around") >= x * (1.0 - local_min_tolerance_bps / BPS)).alias("is_local_min"),
        flag(full, F.col("max_ahead") <= bound).alias("held_favourable"),
        flag(full, F.col("median_ahead") > bound).alias("held_window_closing"),
        F.when(full, F.col("known")).alias("label_available_on"),
        full.alias("outcome_complete"),
    )


def hit_column(scenario: str) -> str:
    return {"favourable_now": "held_favourable", "window_closing": "held_window_closing"}[scenario]


def horizon_hit_rates(panel: DataFrame, events: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 10, 20), scenario: str = "favourable_now", **options) -> DataFrame:
    """One row per series of ``events`` (iso, quote_date) with the hit rate at each horizon."""
    keys = events.select("iso", "quote_date").distinct()
    hit = hit_column(scenario)
    parts = [keys.join(build_labels(panel, horizon=h, **options).filter("outcome_complete").select("iso", "quote_date", F.lit(h).alias("h"), F.col(hit).cast("int").alias("hit")), ["iso", "quote_date"]) for h in horizons]
    rates = reduce(DataFrame.unionByName, parts).groupBy("iso").pivot("h", list(horizons)).agg(F.avg("hit"))
    return rates.withColumnsRenamed({str(h): f"hit_h{h}" for h in horizons})


def build_outcomes(panel: DataFrame, horizon: int = 20, epsilon_bps: float = 30.0) -> DataFrame:
    """Outcomes without an execution delay: median and least of the next ``horizon`` quotes, early_send null if open."""
    ahead = o().rowsBetween(1, horizon)
    df = panel.withColumns({"n": F.count(V).over(ahead), "mid": _middle(ahead), "low": F.min(V).over(ahead), "known": F.lead("available_on", horizon).over(o())})
    full, v = F.col("n") == horizon, F.col(V)
    return df.select(
        *panel.columns,
        F.when(full, F.col("mid")).alias("future_median"),
        F.when(full, F.col("low")).alias("future_minimum"),
        F.when(full, (F.col("mid") - v) / v * BPS).alias("advantage_bps"),
        F.when(full, F.col("low") < v * (1 - epsilon_bps / BPS)).alias("early_send"),
        F.when(full, F.greatest(F.lit(0.0), (v - F.col("low")) / v * BPS)).alias("regret_bps"),
        F.when(full, F.col("known")).alias("outcome_available_on"),
        full.alias("outcome_complete"),
    )


def make_target(panel: DataFrame, horizon: int) -> DataFrame:
    """iso, quote_date, target (relative advantage of the median), target_available_on; rows with a full window."""
    done = build_outcomes(panel, horizon).filter("outcome_complete")
    return done.select("iso", "quote_date", ((F.col("future_median") - F.col(V)) / F.col(V)).alias("target"), F.col("outcome_available_on").alias("target_available_on"))


def matured_before(labels: DataFrame) -> DataFrame:
    """Adds k: how many labels of the series are known by the row's own decision date (its available_on).

    Maturities never run backwards within a series once the running maximum is taken; open labels count as far
    future. Both kinds of dates are laid in one order, maturities first, and counted.
    """
    known = F.max(F.coalesce("label_available_on", F.lit("9999-12-31").cast("date"))).over(o().rowsBetween(Window.unboundedPreceding, 0))
    dated = labels.withColumn("_known", known)
    events = dated.select("iso", F.col("_known").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("date").alias("quote_date")).unionByName(
        dated.select("iso", F.col("available_on").alias("at"), F.lit(1).alias("kind"), "quote_date")
    )
    order = Window.partitionBy("iso").orderBy("at", "kind", "quote_date").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("k", F.sum(1 - F.col("kind")).over(order)).filter("kind = 1").select("iso", "quote_date", "k")
    return labels.join(counted, ["iso", "quote_date"])

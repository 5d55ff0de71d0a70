"""Backward-looking features and rule scores of every observation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempo.functions.windows import ew_zscore, last_rows, log_return, o, roll, rolling_rank, with_ewma, with_streak

# Names of features and rules, and a vetoed day's score, which is finite so that quantiles stay defined.
FEATURES = (
    "ewma_zscore", "residual_pct", "down_streak", "ret_1", "ret_5", "ret_10", "ret_20", "accel_5", "vol_20", "vol_ratio", "drawdown_60",
    "pct_rank_90", "dist_to_min_90", "rub_strength", "month_sin", "month_cos", "dom_sin", "dom_cos", "seasonal_zscore", "days_to_eom",
    "is_month_start", "is_month_end",
)
BLOCKED = -1e6
RULES = ("percentile", "zscore", "momentum", "drawdown", "seasonal", "reversal")
V = "rub_per_unit"


def calendar(df: DataFrame) -> DataFrame:
    d, month, dom = F.col("quote_date"), F.month("quote_date"), F.dayofmonth("quote_date")
    length = F.dayofmonth(F.last_day(d))
    turn = lambda f, x, n: f(x * (2 * math.pi) / n)
    return df.withColumns({
        "month_sin": turn(F.sin, month, 12.0), "month_cos": turn(F.cos, month, 12.0), "dom_sin": turn(F.sin, dom, 31.0), "dom_cos": turn(F.cos, dom, 31.0),
        "days_to_eom": length - dom, "is_month_start": (dom <= 5).cast("int"), "is_month_end": (length - dom < 5).cast("int"),
    })


def seasonal_zscore() -> Column:
    """Against the five observations before today that fall in the same month of the year, three at least."""
    w = Window.partitionBy("iso", F.month("quote_date")).orderBy("quote_date").rowsBetween(-5, -1)
    enough = F.count(V).over(w) >= 3
    return F.when(enough, (F.col(V) - F.avg(V).over(w)) / F.nullif(F.stddev_samp(V).over(w), F.lit(0.0)))


def usd_strength(usd: DataFrame, span: int = 60) -> DataFrame:
    """quote_date, rub_strength: the USD series against its exponential mean; of each cut by itself where there are cuts."""
    kept = [c for c in ("quote_date", "cut") if c in usd.columns]
    return with_ewma(usd.select("iso", V, *kept), V, (span,)).select(*kept, (F.col(V) / F.col(f"mean_{span}") - 1).alias("rub_strength"))


def compute_features(panel: DataFrame, usd: DataFrame | None = None, ewma_span: int = 60, pct_window: int = 250, vol_window: int = 20, dd_window: int = 60) -> DataFrame:
    """The panel with all features. ``usd`` is the USD series, from the panel itself unless given.

    Where both are cut into prefixes (a column ``cut``), a prefix meets the USD series of the same cut only.
    """
    df = with_ewma(panel, V, (ewma_span,))
    df = df.withColumns({
        "residual": F.col(V) - F.col(f"mean_{ewma_span}"), "ewma_zscore": ew_zscore(V, ewma_span), "ret_1": log_return(V, 1), "ret_5": log_return(V, 5),
        "ret_10": log_return(V, 10), "ret_20": log_return(V, 20), "pct_rank_90": rolling_rank(V, 90, 20), "seasonal_zscore": seasonal_zscore(),
    })
    high, low = roll(F.max, V, dd_window, 5), roll(F.min, V, 90, 20)
    df = df.withColumns({
        "residual_pct": rolling_rank("residual", pct_window, 20), "accel_5": F.col("ret_5") - F.lag("ret_5", 5).over(o()),
        "vol_20": roll(F.stddev_samp, "ret_1", vol_window, 5), "vol_60": roll(F.stddev_samp, "ret_1", 60, 10),
        "drawdown_60": (high - F.col(V)) / high, "dist_to_min_90": (F.col(V) - low) / low,
    })
    df = with_streak(df.withColumn("vol_ratio", F.col("vol_20") / F.nullif(F.col("vol_60"), F.lit(0.0))), V, "down_streak")
    strength = usd_strength(panel.filter("iso = 'USD'") if usd is None else usd, ewma_span)  # one series: a row per day
    return calendar(df).join(strength, [c for c in ("quote_date", "cut") if c in strength.columns], "left").select("quote_date", "available_on", "iso", V, *FEATURES)


def rule_score(rule: str) -> Column:
    """A rule's score from the features; higher means a better day to send."""
    near = F.when(F.col("ret_1") > 0, -F.col("dist_to_min_90")).otherwise(BLOCKED)
    return {
        "percentile": 1 - F.col("pct_rank_90"), "zscore": -F.col("ewma_zscore"), "momentum": F.col("down_streak") - F.col("ret_5"),
        "drawdown": F.col("drawdown_60"), "seasonal": -F.col("seasonal_zscore"), "reversal": near,
    }[rule]


def rule_matrix(features: DataFrame) -> DataFrame:
    """Every rule as a column; the reversal is split into closeness to the low and the turn."""
    plain = [rule_score(r).alias(r) for r in RULES if r != "reversal"]
    turned = F.coalesce((F.col("ret_1") > 0).cast("double"), F.lit(0.0))
    return features.select("quote_date", "available_on", "iso", V, *plain, (-F.col("dist_to_min_90")).alias("near_min"), turned.alias("turned_up"))


def trailing_ranks(features: DataFrame, n: int = 250, k: int = 60) -> DataFrame:
    """Each rule's rank among its own last ``n`` scores."""
    scored = features.select("quote_date", "available_on", "iso", V, *[rule_score(r).alias(f"s_{r}") for r in RULES])
    return scored.select("quote_date", "available_on", "iso", V, *[rolling_rank(f"s_{r}", n, k).alias(r) for r in RULES])


def blend_scores(ranks: DataFrame, high: float = 0.70) -> DataFrame:
    """rank_blend: mean of the ranks there are; consensus: how many exceed ``high``, plus that mean."""
    held = F.filter(F.array(*RULES), lambda x: x.isNotNull())
    mean = F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))
    many = F.size(F.filter(held, lambda x: x > high))
    return ranks.select("quote_date", "available_on", "iso", V, mean.alias("rank_blend"), (many + mean).alias("consensus"))

"""Tables behind the charts of an evaluation, from its stored artefacts: what is drawn, in the order it is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempo.operators.features import RULES

# The steps from the plain rule to the shipped signal, the shipped one's name, and the model set against rules.
LADDER = (("zscore", "fixed window"), ("zscore_tuned", "window chosen walk-forward"), ("zscore_truthful", "silent without a true fact"), ("zscore_vetoed", "the days that it refuses"))
SHIPPED, MODEL = "zscore_truthful", "utility_risk"
UPLIFT = "currency_uplift_bps"


def corridor_points(corridors: DataFrame, strategies: list[str]) -> DataFrame:
    """A point per strategy and series: its uplift, whether it is significant, and how many of the strategy's are positive."""
    w = Window.partitionBy("strategy")
    rows = corridors.filter(F.col("strategy").isin(strategies))
    return rows.select("strategy", "iso", UPLIFT, "q_value", F.coalesce("significant_fdr", F.lit(False)).alias("solid"), F.count_if(F.col(UPLIFT) > 0).over(w).alias("n_positive"), F.count(F.lit(1)).over(w).alias("n_series"))


def rules_comparison(board: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """The model and the plain rules by uplift, best first; those without a signal are left out."""
    rows = board.filter(F.col("strategy").isin(MODEL, *rules) & F.col(UPLIFT).isNotNull())
    place = F.row_number().over(Window.orderBy(F.desc(UPLIFT), "strategy"))  # a row per strategy
    return rows.select(place.alias("place"), "strategy", UPLIFT, "corridors_positive", "n_corridors", (F.col("strategy") == MODEL).alias("is_model"))


def ladder(board: DataFrame) -> DataFrame:
    """The steps to the shipped signal in their order, those that were evaluated."""
    steps = F.create_map(*[F.lit(x) for i, (name, _) in enumerate(LADDER) for x in (name, i)])
    labels = F.create_map(*[F.lit(x) for pair in LADDER for x in pair])
    rows = board.withColumn("step", steps[F.col("strategy")]).filter(F.col("step").isNotNull() & F.col(UPLIFT).isNotNull())
    return rows.select("step", "strategy", labels[F.col("strategy")].alias("label"), UPLIFT, (F.col("strategy") == SHIPPED).alias("shipped")).orderBy("step")


def cadence_line(sweep: DataFrame) -> DataFrame:
    """Each strategy's points from rare to frequent; budgets without a signal have none."""
    place = F.row_number().over(Window.partitionBy("strategy").orderBy("per_week", "cadence"))
    return sweep.filter(F.col("per_week").isNotNull() & F.col(UPLIFT).isNotNull()).select("strategy", place.alias("place"), "cadence", "per_week", UPLIFT)


def rate_points(panel: DataFrame, signals: DataFrame, iso: str, start: str) -> DataFrame:
    """One series' quotes from ``start`` on, each with the strategies that sent on it and what that gained."""
    begin = F.lit(start).cast("date")
    line = panel.filter((F.col("iso") == iso) & (F.col("quote_date") >= begin)).select("quote_date", F.col("rub_per_unit").alias("rate"))
    sent = signals.filter((F.col("iso") == iso) & (F.col("quote_date") >= begin)).groupBy("quote_date").agg(F.array_sort(F.collect_list(F.struct("strategy", F.round("currency_gain_bps", 4).alias("gain_bps")))).alias("marks"))  # a strategy each
    return line.join(sent, "quote_date", "left")

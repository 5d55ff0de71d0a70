"""What a fixed monthly budget buys when spent on signals, at a regular pace, or on random days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempo.functions.windows import o
from tempo.operators import stats
from tempo.operators.indicators import next_on_or_after

V = "rub_per_unit"


def budgets(panel: DataFrame, monthly: float = 50_000.0) -> DataFrame:
    """iso, total to spend, number of days: the monthly budget times calendar months, one at least."""
    months = F.greatest(F.lit(1.0), F.date_diff(F.max("quote_date"), F.min("quote_date")) / 30.44)
    return panel.groupBy("iso").agg((F.lit(monthly) * months).alias("total"), F.count(F.lit(1)).alias("days"))


def buy(days: DataFrame, per: DataFrame) -> DataFrame:
    """currency, avg_rate, n_buys per series; ``per`` has iso and the roubles of one buy."""
    return days.join(per, "iso").groupBy("iso").agg(F.sum(F.col("per") / F.col(V)).alias("currency"), F.avg(V).alias("avg_rate"), F.count(F.lit(1)).alias("n_buys"))


def regular_days(panel: DataFrame, every: int = 5) -> DataFrame:
    """Every ``every``-th observation, from the first."""
    return panel.withColumn("_at", F.row_number().over(o()) - 1).filter(F.col("_at") % every == 0).drop("_at")


def simulate(panel: DataFrame, events: DataFrame, monthly: float = 50_000.0, every: int = 5, trials: int = 500, seed: int = 0) -> DataFrame:
    """strategy (model, dca, random), currency, avg_rate, n_buys per series.

    Each strategy splits the same total over its own buys. A signal buys on its day or the next with a quote; one
    without keeps its share unspent. Random days are as many as the signals, and buy nothing if there are not more days.
    """
    total = budgets(panel, monthly)
    n = events.groupBy("iso").agg(F.count(F.lit(1)).alias("n"))
    quotes = panel.select("iso", F.col("quote_date").alias("mark_date"))
    on = next_on_or_after(events, quotes, strict=False).filter("mark_date is not null").withColumnRenamed("mark_date", "quote_date").join(panel.select("iso", "quote_date", V), ["iso", "quote_date"])
    per = total.join(n, "iso").select("iso", (F.col("total") / F.col("n")).alias("per"), "n", "days")
    model = buy(on, per).withColumn("strategy", F.lit("model"))
    regular = regular_days(panel, every)
    paced = regular.groupBy("iso").agg(F.count(F.lit(1)).alias("n")).join(total, "iso").select("iso", (F.col("total") / F.col("n")).alias("per"))
    dca = buy(regular, paced).withColumn("strategy", F.lit("dca"))
    pool = stats.with_trials(panel.select("iso", "quote_date", V).join(per.filter("days > n"), "iso"), trials)
    order = Window.partitionBy("iso", "trial").orderBy(stats.draw_key(seed, "trial", "iso", "quote_date"))
    drawn = pool.withColumn("_at", F.row_number().over(order)).filter("_at <= n")
    each = drawn.groupBy("iso", "trial").agg(F.sum(F.col("per") / F.col(V)).alias("currency"), F.avg(V).alias("avg_rate"), F.count(F.lit(1)).alias("n_buys"))
    rand = each.groupBy("iso").agg(F.avg("currency").alias("currency"), F.avg("avg_rate").alias("avg_rate"), F.max("n_buys").alias("n_buys")).withColumn("strategy", F.lit("random"))
    return model.unionByName(dca).unionByName(rand)


def uplift(results: DataFrame) -> DataFrame:
    """iso, uplift_vs_dca, uplift_vs_random in percent."""
    wide = results.groupBy("iso").pivot("strategy", ["model", "dca", "random"]).agg(F.first("currency"))
    rise = lambda a, b: F.when(F.col(b) != 0, (F.col(a) - F.col(b)) / F.col(b) * 100)
    return wide.select("iso", rise("model", "dca").alias("uplift_vs_dca"), rise("model", "random").alias("uplift_vs_random"))

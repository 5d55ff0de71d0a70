"""Resampling and significance over DataFrames. Draws come from MD5 of seed, trial and key, so they repeat anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempo.functions.storage import cut_lineage


def draw_key(seed: int, *parts: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def with_trials(df: DataFrame, trials: int) -> DataFrame:
    """Every row once per trial number; the number of trials is a parameter."""
    return df.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))


def matched_random_schedules(log: DataFrame, trials: int, seed: int = 0) -> DataFrame:
    """Random days without replacement, as many per (iso, window_id) as were selected, in every trial.

    ``log`` holds iso, quote_date, window_id, decision of the days that may be drawn.
    """
    counts = log.groupBy("iso", "window_id").agg(F.count_if("decision").alias("n_take")).filter("n_take > 0")
    drawn = with_trials(log.join(counts, ["iso", "window_id"]), trials)
    order = Window.partitionBy("trial", "iso", "window_id").orderBy(draw_key(seed, "trial", "iso", "quote_date"))
    return drawn.withColumn("place", F.row_number().over(order)).filter("place <= n_take").drop("place", "n_take")


def fold_null(universe: DataFrame, cells: DataFrame, trials: int, seed: int, metrics: list[str]) -> DataFrame:
    """Means of ``metrics`` per (strategy, iso, fold, trial) over random schedules that spend a cell's own budget."""
    spent = cells.filter("n_signals > 0").select("strategy", "iso", "fold", "n_signals")
    sizes = universe.groupBy("iso", "fold").agg(F.count(F.lit(1)).alias("_days"))
    wanted = spent.join(sizes, ["iso", "fold"]).select("strategy", "iso", "fold", "n_signals", F.least("n_signals", "_days").alias("place"))
    most = wanted.groupBy("iso", "fold").agg(F.max("place").alias("most"))
    # every strategy of a fold draws the same days in the same order, so one order per trial serves all of them
    pool = with_trials(universe.select("iso", "fold", "quote_date", *metrics).join(most, ["iso", "fold"]), trials).withColumn("key", draw_key(seed, "trial", "iso", "quote_date"))
    order = Window.partitionBy("iso", "fold", "trial").orderBy("key")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    taken = pool.withColumn("place", F.row_number().over(order).cast("long")).filter("place <= most")
    drawn = taken.select("iso", "fold", "trial", "place", *[F.avg(F.col(m).cast("double")).over(so_far).alias(m) for m in metrics])
    return drawn.join(wanted, ["iso", "fold", "place"]).drop("place")


def weighted_mean(value: str, weight: str) -> Column:
    """Mean by weight over rows that have a value and a positive weight; null without any."""
    usable = F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.try_divide(F.sum(F.when(usable, F.col(value) * F.col(weight))), F.sum(F.when(usable, F.col(weight))))


def pooled_null(null: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Trials weighted by the signals of their cells."""
    return null.groupBy(*keys, "trial").agg(*[weighted_mean(m, "n_signals").alias(m) for m in metrics])


def permutation_pvalue(null: DataFrame, observed: DataFrame, keys: list[str], value: str, alternative: str = "greater") -> DataFrame:
    """(hits + 1) / (draws + 1) per key; ``observed`` has one row per key. Values that agree to nine places are equal."""
    both = null.select(*keys, F.round(value, 9).alias("_n")).filter("_n is not null").join(observed.select(*keys, F.round(value, 9).alias("_o")), keys)
    mid = F.avg("_n").over(Window.partitionBy(*keys))
    hit = {"greater": F.col("_n") >= F.col("_o"), "less": F.col("_n") <= F.col("_o"), "two-sided": F.abs(F.col("_n") - F.col("_m")) >= F.abs(F.col("_o") - F.col("_m"))}[alternative]
    return both.withColumn("_m", mid).groupBy(*keys).agg(((F.count_if(hit) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("draws"))


def pvalue(value: str, observed: str) -> Column:
    """``permutation_pvalue`` of one group as an aggregate: the share of trials as high as ``observed``; null without any."""
    hit = F.round(value, 9) >= F.round(observed, 9)
    return F.when(F.count(value) > 0, (F.count_if(hit) + 1) / (F.count(value) + 1))


def benjamini_hochberg(tests: DataFrame, family: list[str], p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Adds q_value and significant_fdr per family; a null p-value has neither."""
    known = F.col(p).isNotNull()
    order = Window.partitionBy(*family, "_known").orderBy(p)
    total = F.count(p).over(Window.partitionBy(*family))
    df = tests.withColumn("_known", known).withColumn("_rank", F.row_number().over(order)).withColumn("_raw", F.when(known, F.col(p) * total / F.col("_rank")))
    down = Window.partitionBy(*family, "_known").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.when(known, F.least(F.lit(1.0), F.min("_raw").over(down)))
    return df.withColumn("q_value", q).withColumn("significant_fdr", F.coalesce(F.col("q_value") <= alpha, F.lit(False))).drop("_known", "_rank", "_raw")


def newey_west(values: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """mean, se, t per key with Bartlett weights and floor(4 (n / 100)^(2/9)) lags; null se and t under three values."""
    w = Window.partitionBy(*keys)
    df = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"), F.col(order).alias("_o"))
    df = df.withColumns({"n": F.count("x").over(w), "d": F.col("x") - F.avg("x").over(w), "at": F.row_number().over(Window.partitionBy(*keys).orderBy("_o"))})
    lags = F.floor(4 * F.pow(F.col("n") / 100, F.lit(2.0 / 9))).cast("int")
    lagged = df.withColumn("lag", F.explode(F.sequence(F.lit(0), F.least(lags, F.col("n") - 1).cast("int")))).withColumn("to", F.col("at") - F.col("lag"))
    partner = df.select(*keys, F.col("at").alias("to"), F.col("d").alias("d_to"))
    product = lagged.join(partner, [*keys, "to"]).groupBy(*keys, "n", "lag").agg((F.sum(F.col("d") * F.col("d_to")) / F.first("n")).alias("cov"))
    bartlett = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (F.floor(4 * F.pow(F.col("n") / 100, F.lit(2.0 / 9))) + 1)))
    variance = product.groupBy(*keys, "n").agg(F.sum(bartlett * F.col("cov")).alias("v"))
    mean = df.groupBy(*keys).agg(F.avg("x").alias("mean"))
    se = F.when((F.col("n") >= 3) & (F.col("v") > 0), F.sqrt(F.col("v") / F.col("n")))
    return mean.join(variance, keys).select(*keys, "n", "mean", se.alias("se"), (F.col("mean") / se).alias("t_stat"))


def block_bootstrap(values: DataFrame, keys: list[str], value: str, order: str, block: int, trials: int, seed: int = 0, level: float = 0.95, draw_by: list[str | Column] | None = None) -> DataFrame:
    """ci_low, ci_high of the mean from resampled blocks of consecutive values, cut to the original number.

    A block's sum is the difference of two running sums, so a trial reads two values a block instead of all of them.
    Groups that agree in ``draw_by`` (all of ``keys`` unless given) draw the same numbers.
    """
    w, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)
    df = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"), F.col(order).alias("_o"))
    sums = df.select(*keys, F.count("x").over(w).alias("n"), F.count("x").over(so_far).alias("at"), F.sum("x").over(so_far).alias("upto"))
    wide = F.least(F.lit(block), F.col("n"))
    plan = with_trials(sums.filter("at = 1").select(*keys, "n"), trials).withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / wide) - 1).cast("int"))))
    number = F.conv(F.substring(draw_key(seed, *(keys if draw_by is None else draw_by), "trial", "block"), 1, 12), 16, 10).cast("long")
    plan = plan.withColumn("begin", F.pmod(number, F.col("n") - wide + 1))
    stop = F.col("begin") + F.least(wide, F.col("n") - F.col("block") * wide)
    ends = F.explode(F.array(F.struct(F.col("begin").cast("long").alias("at"), F.lit(-1.0).alias("sign")), F.struct(stop.cast("long").alias("at"), F.lit(1.0).alias("sign"))))
    marks = plan.select(*keys, "trial", "n", ends.alias("e")).select(*keys, "trial", "n", "e.at", "e.sign").filter("at > 0")
    means = marks.join(sums.select(*keys, "at", "upto"), [*keys, "at"]).groupBy(*keys, "trial", "n").agg((F.sum(F.col("sign") * F.col("upto")) / F.col("n")).alias("m"))
    low = (1 - level) / 2
    return means.groupBy(*keys).agg(F.expr(f"percentile(m, {low!r}D)").alias("ci_low"), F.expr(f"percentile(m, {1 - low!r}D)").alias("ci_high"))


def significance(values: DataFrame, keys: list[str], columns: dict[str, str], order: str, block: int, trials: int, seed: int = 0, draw_by: list[str | Column] | None = None) -> DataFrame:
    """<name>_ci_low, <name>_ci_high, <name>_hac_se, <name>_hac_t of each of ``columns`` (name: column) per key.

    Columns share the draws of their key (or of ``draw_by``); each counts its own values. Bounds and errors are kept as tables of their own.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("x")) for name, c in columns.items()]))
    tall = values.select(*keys, F.col(order).alias("_o"), each.alias("_v")).select(*keys, "_o", "_v.metric", "_v.x").filter("x is not null")
    by = [*keys, "metric"]
    bounds, errors = cut_lineage(block_bootstrap(tall, by, "x", "_o", block, trials, seed, draw_by=draw_by or keys)), cut_lineage(newey_west(tall, by, "x", "_o"))
    both = bounds.join(errors, by)
    found = [F.first("ci_low").alias("ci_low"), F.first("ci_high").alias("ci_high"), F.first("se").alias("hac_se"), F.first("t_stat").alias("hac_t")]
    return both.groupBy(*keys).pivot("metric", list(columns)).agg(*found)


def histogram(values: DataFrame, keys: list[str], value: str, bins: int = 36) -> DataFrame:
    """bin (1-based), n between each key's least and greatest value; the greatest falls into the last bin."""
    w = Window.partitionBy(*keys)
    df = values.filter(F.col(value).isNotNull()).withColumns({"_lo": F.min(value).over(w), "_hi": F.max(value).over(w)})
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1)).otherwise(1)
    return df.withColumn("bin", place.cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))

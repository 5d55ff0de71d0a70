"""Event indicators, their hit rules against random days, as-of comparisons and verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempo.functions.windows import o, roll, with_streak
from tempo.operators.policy import cooldown_emission

V = "rub_per_unit"
EVENTS = ("iso", "signal_date", V)
LIFT_FLOOR, LIFT_TARGET, FREQ_MIN, FREQ_MAX = 1.0, 1.3, 1.0, 2.0
# Each indicator's speed and the parameters that calibration tries.
SPEED = {"value": "fast", "momentum": "fast", "value_reversal": "medium", "reversal_from_min": "slow", "model_ridge": "model"}
GRIDS = {
    "value": {"window": (20, 60, 120), "lo_pct": (0.1, 0.2, 0.3)},
    "momentum": {"n": (3, 5)},
    "value_reversal": {"window": (20, 60, 120), "lo_pct": (0.2, 0.3)},
    "reversal_from_min": {"window": (60, 120), "pct": (0.01, 0.02)},
}


def _events(df: DataFrame, mask: Column) -> DataFrame:
    return df.filter(F.coalesce(mask, F.lit(False))).select("iso", F.col("quote_date").alias("signal_date"), V)


def _position(window: int) -> tuple[Column, Column]:
    low, high = roll(F.min, V, window, max(5, window // 4)), roll(F.max, V, window, max(5, window // 4))
    return low, (F.col(V) - low) / F.nullif(high - low, F.lit(0.0))


def _rising() -> Column:
    return F.col(V) > F.lag(V).over(o())


def value(panel: DataFrame, window: int = 60, lo_pct: float = 0.2) -> DataFrame:
    """Days in the lowest part of the trailing range."""
    df = panel.withColumn("_p", _position(window)[1])
    return _events(df, F.col("_p") < lo_pct)


def momentum(panel: DataFrame, n: int = 3) -> DataFrame:
    """Days that end a run of at least ``n`` falls."""
    return _events(with_streak(panel, V, "_s"), F.col("_s") >= n)


def value_reversal(panel: DataFrame, window: int = 60, lo_pct: float = 0.2) -> DataFrame:
    """Days in the lowest part of the range on which the rate rose."""
    df = panel.withColumns({"_p": _position(window)[1], "_up": _rising()})
    return _events(df, (F.col("_p") < lo_pct) & F.col("_up"))


def reversal_from_min(panel: DataFrame, window: int = 60, pct: float = 0.005) -> DataFrame:
    """Days just above the trailing low on which the rate rose."""
    df = panel.withColumns({"_low": _position(window)[0], "_up": _rising()})
    return _events(df, ((F.col(V) - F.col("_low")) / F.col("_low") < pct) & F.col("_up"))


def model_ridge(predictions: DataFrame, slots_per_week: float = 1.5) -> DataFrame:
    """Days that a fitted ``prediction`` singles out, about ``slots_per_week`` of them."""
    return cooldown_emission(predictions, slots_per_week).select("iso", F.col("quote_date").alias("signal_date"), V)


INDICATORS = {"value": value, "momentum": momentum, "value_reversal": value_reversal, "reversal_from_min": reversal_from_min}


def all_events(panel: DataFrame, grids: Mapping[str, Mapping[str, Sequence[float]]] = GRIDS) -> DataFrame:
    """indicator, turn (place in the grid), params, iso, signal_date and the rate of all parameters' signals.

    One pass over the panel: every trailing window, streak and turn is worked out once, and a day is spread to the
    parameters that it satisfies.
    """
    sets = [(name, turn, given) for name, grid in grids.items() for turn, given in enumerate(parameter_sets(grid))]
    windows = sorted({given["window"] for _, _, given in sets if "window" in given})
    df = with_streak(panel, V, "_s").withColumn("_up", _rising())
    for w in windows:
        low, place = _position(w)
        df = df.withColumns({f"_low_{w}": low, f"_p_{w}": place})

    def mask(name: str, given: Mapping[str, float]) -> Column:
        if name == "momentum":
            return F.col("_s") >= given["n"]
        if name == "reversal_from_min":
            low = F.col(f"_low_{given['window']}")
            return ((F.col(V) - low) / low < given["pct"]) & F.col("_up")
        below = F.col(f"_p_{given['window']}") < given["lo_pct"]
        return below & F.col("_up") if name == "value_reversal" else below

    each = [F.when(F.coalesce(mask(n, g), F.lit(False)), F.struct(F.lit(n).alias("indicator"), F.lit(turn).alias("turn"), F.lit(key_of(g)).alias("params"))) for n, turn, g in sets]
    return df.select("iso", F.col("quote_date").alias("signal_date"), V, F.explode(F.array_compact(F.array(*each))).alias("e")).select("e.*", "iso", "signal_date", V)


def key_of(given: Mapping[str, object]) -> str:
    """``a=1,b=2`` with sorted names."""
    return ",".join(f"{k}={v}" for k, v in sorted(given.items()))


def parameter_sets(grid: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """Every combination of a short grid, the last name varying fastest."""
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def parameter_grid(spark: SparkSession, grid: Mapping[str, Sequence[float]]) -> DataFrame:
    """Every combination of a few parameter values, one column each."""
    out = spark.range(1).drop("id")
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def params_key(params: Column) -> Column:
    """``a=1,b=2`` with sorted names, from a map."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")


def params_of(key: Column) -> Column:
    """The map of ``a=1,b=0.5,c=x`` from a key: each value as a whole number, else a fraction, else text; the first that fits.

    Every value is a struct of whole, fraction and text, of which one is set.
    """

    def typed(_, text: Column) -> Column:
        whole = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("long"))
        fraction = F.when(whole.isNull(), text.try_cast("double"))
        return F.struct(whole.alias("whole"), fraction.alias("fraction"), F.when(whole.isNull() & fraction.isNull(), text).alias("text"))

    pairs = F.when(key == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(key, F.lit(","), F.lit("=")))
    return F.transform_values(pairs, typed)


def future_paths(panel: DataFrame, h: int) -> DataFrame:
    """The next quotes of each day, ``h`` at most, as an array."""
    return panel.select("iso", F.col("quote_date").alias("signal_date"), V, F.collect_list(V).over(o().rowsBetween(1, h)).alias("future"))


def held(h: int, eps_bps: float = 0.0) -> dict[str, Column]:
    """Whether a day's message held over the next ``h`` quotes or as many as there are; false without any."""
    w, bound = o().rowsBetween(1, h), F.col(V) * (1 + eps_bps / 10_000.0) + 1e-12
    return {
        "favourable_now": F.coalesce(F.max(V).over(w) <= bound, F.lit(False)),
        "window_closing": F.coalesce(F.expr(f"percentile({V}, 0.5)").over(w) > bound, F.lit(False)),
    }


def hit_rates(panel: DataFrame, events: DataFrame, h: int, scenario: str, eps_bps: float = 0.0) -> DataFrame:
    """n_signals, hit_rate, random_hit and lift per series and over all.

    The random side is the expectation of drawing that many days with replacement from each series' days with a full
    horizon, which repeated draws only approximate.
    """
    w = Window.partitionBy("iso")
    days = panel.withColumns({"hit": held(h, eps_bps)[scenario].cast("double"), "at": F.row_number().over(o()), "n": F.count(F.lit(1)).over(w)})
    base = days.filter("at <= n - %d" % h).groupBy("iso").agg(F.avg("hit").alias("random_hit"))
    own = events.join(days.select("iso", F.col("quote_date").alias("signal_date"), "hit"), ["iso", "signal_date"]).groupBy("iso").agg(F.count(F.lit(1)).alias("n_signals"), F.sum("hit").alias("hits"))
    both = own.join(base, "iso", "left")
    rolled = both.rollup("iso").agg(F.sum("n_signals").alias("n_signals"), (F.sum("hits") / F.sum("n_signals")).alias("hit_rate"), (F.sum(F.col("random_hit") * F.col("n_signals")) / F.sum(F.when(F.col("random_hit").isNotNull(), F.col("n_signals")))).alias("random_hit"))
    return rolled.select(F.coalesce("iso", F.lit("ALL")).alias("iso"), "n_signals", "hit_rate", "random_hit", F.when(F.col("random_hit") > 0, F.col("hit_rate") / F.col("random_hit")).alias("lift"))


def window_advantage(panel: DataFrame, events: DataFrame, h: int, by_series: bool = False) -> DataFrame:
    """mean, stderr, t of the advantage over the (cut) window of ``h`` days either side, and n, over all events.

    With ``by_series`` there is a row per series, and that of all events under ``ALL``.
    """
    w = o().rowsBetween(-h, h)
    days = panel.select("iso", F.col("quote_date").alias("signal_date"), F.when(F.count(V).over(w) >= 2, (F.avg(V).over(w) - F.col(V)) / F.col(V) * 10_000.0).alias("adv"))
    got = events.select("iso", "signal_date").join(days, ["iso", "signal_date"]).filter("adv is not null")
    figures = [F.avg("adv").alias("advantage_bps"), (F.stddev_samp("adv") / F.sqrt(F.count("adv"))).alias("stderr"), F.count("adv").alias("n")]
    out = got.rollup("iso").agg(*figures).withColumn("iso", F.coalesce("iso", F.lit("ALL"))) if by_series else got.agg(*figures)
    return out.withColumn("t_stat", F.try_divide("advantage_bps", "stderr"))


def metric_matrix(panel: DataFrame, events: DataFrame, horizons: Sequence[int] = (5, 15), scenario: str = "favourable_now") -> DataFrame:
    """Hit rates, lifts and advantages of each series and of all at several horizons."""
    parts = []
    for h in horizons:
        money = window_advantage(panel, events, h, by_series=True).select("iso", "advantage_bps", F.col("t_stat").alias("advantage_tstat"))
        parts.append(hit_rates(panel, events, h, scenario).join(money, "iso", "left").withColumn("horizon", F.lit(h)))
    return reduce(DataFrame.unionByName, parts)


def next_on_or_after(events: DataFrame, marks: DataFrame, strict: bool) -> DataFrame:
    """For each event (iso, signal_date) the first mark (iso, mark_date) after it, or on it unless ``strict``.

    Both kinds of dates are laid in one order per series; the nearest mark ahead is carried back.
    """
    kind = 0 if strict else 1
    both = events.select("iso", F.col("signal_date").alias("at"), F.lit(1 - kind).alias("kind"), F.lit(True).alias("is_event"), F.lit(None).cast("date").alias("mark")).unionByName(
        marks.select("iso", F.col("mark_date").alias("at"), F.lit(kind).alias("kind"), F.lit(False).alias("is_event"), F.col("mark_date").alias("mark"))
    )
    ahead = Window.partitionBy("iso").orderBy("at", "kind").rowsBetween(1, Window.unboundedFollowing)
    return both.withColumn("mark_date", F.first("mark", ignorenulls=True).over(ahead)).filter("is_event").select("iso", F.col("at").alias("signal_date"), "mark_date")


def waiting_cost(panel: DataFrame, fast: DataFrame, slow: DataFrame) -> DataFrame:
    """Median move in bps from each fast signal to the first slow one strictly after it, per series."""
    met = next_on_or_after(fast, slow.select("iso", F.col("signal_date").alias("mark_date")), strict=True).filter("mark_date is not null")
    rate = panel.select("iso", "quote_date", V)
    joined = met.join(rate.withColumnsRenamed({"quote_date": "signal_date", V: "from_rate"}), ["iso", "signal_date"]).join(rate.withColumnsRenamed({"quote_date": "mark_date", V: "to_rate"}), ["iso", "mark_date"])
    return joined.withColumn("bps", (F.col("to_rate") / F.col("from_rate") - 1) * 10_000).groupBy("iso").agg(F.count(F.lit(1)).alias("n_pairs"), F.expr("percentile(bps, 0.5)").alias("median_bps"))


def calibrate(scored: DataFrame) -> DataFrame:
    """Best parameters per (indicator, iso): greatest median uplift over at least two folds, the first of the grid on ties.

    ``scored`` has indicator, iso, params, turn (place in the grid), fold, uplift.
    """
    mid = scored.filter("uplift is not null").groupBy("indicator", "iso", "params", "turn").agg(F.expr("percentile(uplift, 0.5)").alias("median_uplift"), F.count(F.lit(1)).alias("n_folds")).filter("n_folds >= 2")
    place = F.row_number().over(Window.partitionBy("indicator", "iso").orderBy(F.desc("median_uplift"), "turn"))
    return mid.withColumn("place", place).filter("place = 1").drop("place", "turn")


def verdicts(matrix: DataFrame) -> DataFrame:
    """keep, marginal or drop from lift_h5, uplift_vs_dca and per_week, with the figures that decided it as ``reason``."""
    lift, dca, week = F.col("lift_h5"), F.col("uplift_vs_dca"), F.col("per_week")
    said = lambda form, *c: F.format_string(form, *[x.cast("double") for x in c])
    lost = F.array_join(F.array_compact(F.array(F.when(lift < LIFT_FLOOR, said("lift %.2f, no better than random days", lift)), F.when(dca <= 0, said("%+.2f%% against a regular pace", dca)))), "; ")
    good = (lift >= LIFT_TARGET) & (dca > 0)
    often = F.coalesce((week < FREQ_MIN) | (week > FREQ_MAX), F.lit(False))
    verdict = F.when(lost != "", "drop").when(good & ~often, "keep").otherwise("marginal")
    both = F.when(lift.isNull() | dca.isNull(), "too few signals to judge").otherwise(said("lift %.2f, %+.2f%% against a regular pace", lift, dca))
    reason = F.when(lost != "", lost).when(good & often, said(f"%.1f a week, outside {FREQ_MIN} to {FREQ_MAX}", week)).when(good, F.concat(both, said(", %.1f a week", week))).otherwise(both)
    return matrix.withColumns({"verdict": verdict, "reason": reason})


def following_quotes(panel: DataFrame, n: int = 5) -> DataFrame:
    """Each day's next quotes, one row per step of at most ``n``, with the drift from the day in bps."""
    ahead = F.array(*[F.struct(F.lit(i).alias("step"), F.lead("quote_date", i).over(o()).alias("next_date"), ((F.lead(V, i).over(o()) / F.col(V) - 1) * 10_000.0).alias("drift_bps")) for i in range(1, n + 1)])
    return panel.select("iso", "quote_date", ahead.alias("_q")).select("iso", "quote_date", F.explode("_q").alias("q")).select("iso", "quote_date", "q.*").filter("next_date is not null")


def usual_choice(scored: DataFrame) -> DataFrame:
    """The most frequent chosen parameter per series, the smaller name on ties."""
    n = scored.groupBy("iso", "chosen").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("iso").agg(F.min_by("chosen", F.struct(-F.col("n"), F.col("chosen"))).alias("chosen"), F.max("n").alias("n"))


def daily_payload(panel: DataFrame) -> DataFrame:
    """One JSON array of (date, rate) per series and month, in date order; a month bounds it."""
    month = panel.groupBy("iso", F.date_format("quote_date", "yyyy-MM").alias("month"))
    points = F.transform(F.array_sort(F.collect_list(F.struct("quote_date", V))), lambda p: F.struct(p.quote_date.alias("d"), F.round(p[V], 6).alias("r")))
    return month.agg(F.to_json(points).alias("payload"), F.count(F.lit(1)).alias("n"))

"""Out-of-time evaluation: folds, cells, matched nulls, leaderboard, gates and sweeps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempo.functions.storage import cut_lineage
from tempo.functions.windows import o
from tempo.operators import stats
from tempo.operators.features import BLOCKED, RULES, blend_scores, compute_features, rule_score, trailing_ranks
from tempo.operators.labels import build_labels, hit_column
from tempo.operators.models import UtilityRiskConfig, net_score, walk_forward_heads, walk_forward_ridge
from tempo.operators.policy import PolicyConfig, apply_policy, best_per_window, selected_by
from tempo.operators.signals import SignalConfig, tuned_scores
from tempo.operators.tuning import WINDOWS, calibrated, percentile_candidates, rule_candidates

WEIGHTED = ("ceiling_bps", "hit_rate", "hit_favourable", "hit_closing", "currency_uplift_bps", "window_advantage_bps", "regret_bps", "bad_push_rate")
SIGNIFICANT = {"window_advantage": "window_advantage_bps", "currency_uplift": "currency_gain_bps"}
NULLS = ("hit_rate", "hit_favourable", "hit_closing", "currency_uplift_bps", "window_advantage_bps", "bad_push_rate")

# Gates (name, metric, operator, bounds) and cadences (label, window, most, cooldown).
GATES = (
    ("G1_lift", "hit_lift", ">=", 1.0, None),
    ("G2_advantage", "window_advantage_ci_low", ">", 0.0, None),
    ("G3_significance", "p_value", "<=", 0.05, None),
    ("G4_frequency", "per_week", "between", 1.0, 2.0),
    ("G5_evenness", "interval_cv", "<=", 1.0, None),
    ("G6_gap", "max_gap_days", "<=", 75.0, None),
    ("G7_risk", "bad_push_delta", "<=", 0.0, None),
)
CADENCES = (("2/week, cooldown 3", "week", 2, 3), ("2/week, cooldown 1", "week", 2, 1), ("1/week", "week", 1, 1), ("4/month", "month", 4, 3), ("2/month", "month", 2, 3), ("1/month", "month", 1, 3))


@dataclass(frozen=True)
class BenchmarkSpec:
    eval_start: str = "1997-01-01"
    fold_months: int = 6
    horizon: int = 10
    execution_offset: int = 1
    random_trials: int = 500
    bootstrap_trials: int = 1000
    seed: int = 0
    policy: PolicyConfig = PolicyConfig(cooldown_observations=1)


@dataclass(frozen=True)
class Strategy:
    """kind: rule, blend, tuned (over ``family``), live, live_vetoed or oracle; selection: policy or weekly_best."""

    name: str
    kind: str
    scenario: str
    family: str = ""
    minimum_score: float | None = None
    selection: str = "policy"


# Names, hit rules and floors of the strategies.
STRATEGIES = {
    s.name: s
    for s in (
        *(Strategy(r, "rule", "favourable_now", r) for r in RULES if r != "reversal"),
        Strategy("reversal", "rule", "window_closing", "reversal", minimum_score=-1e5),
        Strategy("zscore_truthful", "live", "favourable_now", minimum_score=BLOCKED / 2),
        Strategy("zscore_vetoed", "live_vetoed", "favourable_now", minimum_score=BLOCKED / 2),
        Strategy("zscore_tuned", "tuned", "favourable_now", "zscore"),
        Strategy("percentile_tuned", "tuned", "favourable_now", "percentile"),
        Strategy("rule_select", "tuned", "window_closing", "rules"),
        Strategy("rank_blend", "blend", "window_closing", "rank_blend"),
        Strategy("consensus", "blend", "window_closing", "consensus"),
        Strategy("utility_only", "model", "window_closing", "0.0"),
        Strategy("utility_risk", "model", "window_closing", "2.0", minimum_score=0.0),
        Strategy("utility_risk_paced", "model", "window_closing", "2.0"),
        Strategy("utility_risk_weekly", "model", "window_closing", "2.0", selection="weekly_best"),
        Strategy("oracle", "oracle", "window_closing"),
        Strategy("oracle_topk", "oracle", "window_closing", selection="weekly_best"),
        Strategy("percentile_weekly", "rule", "favourable_now", "percentile", selection="weekly_best"),
    )
}


def get_strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise KeyError(f"no strategy {name!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[name]


BASE = ("quote_date", "available_on", "iso", "rub_per_unit")


def _stacked(rows: DataFrame, scores: dict[str, Column]) -> DataFrame:
    """One row per strategy name and row of ``rows``, with its score."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), c.cast("double").alias("score")) for n, c in scores.items()]))
    return rows.select(*BASE, each.alias("s")).select(*BASE, "s.strategy", "s.score")


def build_scores(panel: DataFrame, strategies: list[Strategy], features: DataFrame, spec: BenchmarkSpec = BenchmarkSpec()) -> DataFrame:
    """quote_date, available_on, iso, rub_per_unit, strategy, score of all ``strategies``.

    Strategies that score from the same table are read off it together: heads are fitted once for all prices of risk,
    the z-score is tuned once for its gated and vetoed forms. Each of these tables is kept by itself: the driver plans
    anew after every stage, so its memory follows the largest plan.
    """
    of = lambda *kinds: [s for s in strategies if s.kind in kinds]
    parts = []
    if found := of("rule"):
        parts.append(cut_lineage(_stacked(features, {s.name: rule_score(s.family) for s in found})))
    if found := of("blend"):
        parts.append(cut_lineage(_stacked(blend_scores(trailing_ranks(features)), {s.name: F.col(s.family) for s in found})))
    if found := of("oracle"):
        parts.append(cut_lineage(_stacked(build_labels(panel, spec.horizon, spec.execution_offset), {s.name: F.col("currency_gain_bps") for s in found})))
    if found := of("model"):
        parts.append(cut_lineage(_stacked(walk_forward_heads(panel, features, UtilityRiskConfig()), {s.name: net_score(float(s.family)) for s in found})))
    for s in [s for s in of("tuned") if s.family == "percentile"]:
        parts.append(cut_lineage(_stacked(calibrated(percentile_candidates(panel), [f"window={n}" for n in WINDOWS]), {s.name: F.col("score")})))
    for s in [s for s in of("tuned") if s.family == "rules"]:
        parts.append(cut_lineage(_stacked(calibrated(rule_candidates(features), [f"rule={r}" for r in RULES]), {s.name: F.col("score")})))
    if found := [s for s in of("live", "live_vetoed", "tuned") if s.kind != "tuned" or s.family == "zscore"]:
        true = F.col("deviation_pct") < 0
        form = {"live": F.when(true, F.col("score")).otherwise(BLOCKED), "live_vetoed": F.when(true, BLOCKED).otherwise(F.col("score")), "tuned": F.col("score")}
        parts.append(cut_lineage(_stacked(tuned_scores(panel, SignalConfig(require_true_fact=False)), {s.name: form[s.kind] for s in found})))
    return reduce(DataFrame.unionByName, parts)


def by_rule(strategies: list[Strategy], favourable: str, closing: str) -> Column:
    """Of two columns the one that each row's strategy is judged by."""
    late = [s.name for s in strategies if hit_column(s.scenario) == "held_window_closing"]
    return F.when(F.col("strategy").isin(late), F.col(closing)).otherwise(F.col(favourable))


def emit(scores: DataFrame, strategies: list[Strategy], policy: PolicyConfig) -> DataFrame:
    """strategy, iso, quote_date of the signals: one policy over all strategies, whose series it keeps apart."""
    series = F.concat_ws("|", "strategy", "iso")
    parts = []
    if weekly := [s.name for s in strategies if s.selection == "weekly_best"]:
        rows = scores.filter(F.col("strategy").isin(weekly)).withColumn("iso", series)
        parts.append(best_per_window(rows, policy.window, policy.max_signals_per_window))
    if sent := [s for s in strategies if s.selection != "weekly_best"]:
        floors = [F.when(F.col("strategy") == s.name, F.lit(s.minimum_score).cast("double")) for s in sent if s.minimum_score is not None]
        rows = scores.filter(F.col("strategy").isin([s.name for s in sent])).withColumn("minimum_score", F.coalesce(*floors, F.lit(None).cast("double"))).withColumn("iso", series)
        parts.append(apply_policy(rows, policy).filter("decision"))
    found = reduce(DataFrame.unionByName, [p.select("strategy", F.substring_index("iso", "|", -1).alias("iso"), "quote_date") for p in parts])
    return found


def folds(spark: SparkSession, start: str, end: str | DataFrame, months: int = 6) -> DataFrame:
    """fold, fold_start, fold_end: consecutive ranges of ``months`` months; ``end`` a date or a one-row DataFrame."""
    last = spark.range(1).select(F.lit(end).cast("date").alias("end")) if isinstance(end, str) else end.toDF("end")
    begun = last.select("end", F.explode(F.expr(f"sequence(DATE'{start}', end, interval {months} month)")).alias("fold_start"))
    stop = F.least(F.date_sub(F.add_months("fold_start", months), 1), F.col("end"))
    return begun.select(F.concat(F.date_format("fold_start", "yyyy-MM"), F.lit(".."), F.date_format(stop, "yyyy-MM")).alias("fold"), "fold_start", stop.alias("fold_end"))


def in_folds(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows with the fold of their quote_date; folds are a few ranges, a row has one at most."""
    return rows.join(F.broadcast(ranges), F.col("quote_date").between(F.col("fold_start"), F.col("fold_end"))).drop("fold_start", "fold_end")


def cells(signals: DataFrame, universe: DataFrame, hit: str) -> DataFrame:
    """Statistics per (strategy, iso, fold). ``signals`` are labelled and have a fold; ``universe`` is all labelled days.

    The ceiling is the mean of the fold's best days, as many as the cell has signals.
    """
    mean = lambda c: F.avg(F.col(c).cast("double"))
    found = signals.groupBy("strategy", "iso", "fold").agg(
        F.count(F.lit(1)).alias("n_signals"), mean(hit).alias("hit_rate"), mean("held_favourable").alias("hit_favourable"), mean("held_window_closing").alias("hit_closing"),
        mean("currency_gain_bps").alias("currency_uplift_bps"), mean("window_advantage_bps").alias("window_advantage_bps"), mean("regret_bps").alias("regret_bps"),
        mean("bad_push").alias("bad_push_rate"),
    )
    best = universe.filter("currency_gain_bps is not null").withColumn("place", F.row_number().over(Window.partitionBy("iso", "fold").orderBy(F.desc("currency_gain_bps"), "quote_date")))
    top = found.select("strategy", "iso", "fold", "n_signals").join(best.select("iso", "fold", "place", "currency_gain_bps"), ["iso", "fold"]).filter("place <= n_signals")
    return found.join(top.groupBy("strategy", "iso", "fold").agg(F.avg("currency_gain_bps").alias("ceiling_bps")), ["strategy", "iso", "fold"], "left")


def all_cells(cell: DataFrame, strategies: list[str], universe: DataFrame, ranges: DataFrame) -> DataFrame:
    """``cell`` with a row for every strategy, series and fold with days, its trading_days and per_week; ``strategies`` are few."""
    days = universe.groupBy("iso", "fold").agg(F.count(F.lit(1)).alias("trading_days")).join(F.broadcast(ranges), "fold")
    named = days.withColumn("strategy", F.explode(F.array(*[F.lit(n) for n in strategies])))
    out = named.join(cell, ["strategy", "iso", "fold"], "left").withColumn("n_signals", F.coalesce("n_signals", F.lit(0).cast("long")))
    return out.withColumn("per_week", F.col("n_signals") / (F.col("trading_days") / 5.0))


def cadence(signals: DataFrame, keys: list[str]) -> DataFrame:
    """interval_cv, max_gap_days, series_share (share of gaps of five calendar days at most), n_signals per key."""
    gap = F.date_diff("quote_date", F.lag("quote_date").over(Window.partitionBy(*keys).orderBy("quote_date")))
    return signals.withColumn("gap", gap).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_signals"), F.try_divide(F.stddev_samp("gap"), F.avg("gap")).alias("interval_cv"), F.max("gap").alias("max_gap_days"),
        F.avg((F.col("gap") <= 5).cast("double")).alias("series_share"),
    )


def pooled_clustering(signals: DataFrame, days: int = 5) -> DataFrame:
    """series_share per signal and interval_cv over all series' gaps in calendar days together."""
    gap = F.date_diff("quote_date", F.lag("quote_date").over(o()))
    gaps = signals.withColumn("gap", gap)
    cv = F.when((F.count("gap") >= 2) & (F.avg("gap") > 0), F.stddev_samp("gap") / F.avg("gap"))
    return gaps.agg((F.count_if(F.col("gap") <= days) / F.count(F.lit(1))).alias("series_share"), cv.alias("interval_cv"))


def frequency(signals: DataFrame, panel: DataFrame) -> DataFrame:
    """per_week, per_month of each series over its trading days (five a week, 21 a month)."""
    days = panel.groupBy("iso").agg(F.countDistinct("quote_date").alias("days"))
    n = signals.groupBy("iso").agg(F.count(F.lit(1)).alias("n_signals"))
    return n.join(days, "iso").select("iso", "n_signals", (F.col("n_signals") / (F.col("days") / 5.0)).alias("per_week"), (F.col("n_signals") / (F.col("days") / 21.0)).alias("per_month"))


POOLED = "*"


def tested(signals: DataFrame, spec: BenchmarkSpec) -> DataFrame:
    """Significance per (strategy, iso), and per strategy over all its series in the rows whose iso is ``POOLED``; one pass serves both."""
    level = lambda iso, order: signals.select("strategy", iso.alias("iso"), order.cast("string").alias("_o"), *SIGNIFICANT.values())
    both = level(F.col("iso"), F.col("quote_date")).unionByName(level(F.lit(POOLED), F.concat_ws("|", "iso", "quote_date")))
    drawn = ["strategy", F.nullif(F.col("iso"), F.lit(POOLED))]  # a null is no part of a key
    return stats.significance(both, ["strategy", "iso"], SIGNIFICANT, "_o", spec.horizon, spec.bootstrap_trials, spec.seed, drawn)


def per_corridor(cell: DataFrame, null: DataFrame, signals: DataFrame, found: DataFrame, days: DataFrame) -> DataFrame:
    """Cells weighted by signals to (strategy, iso), with cadence, matched null, significance (``found``) and false discovery control."""
    keys = ["strategy", "iso"]
    rolled = cut_lineage(cell.groupBy(*keys).agg(F.sum("n_signals").alias("n_signals"), *[stats.weighted_mean(m, "n_signals").alias(m) for m in WEIGHTED]))
    rhythm = cadence(signals, keys).drop("n_signals")
    pooled = stats.pooled_null(null, keys, list(NULLS))
    compared = cut_lineage(null_comparison(rolled, pooled, keys))
    out = rolled.join(rhythm, keys, "left").join(compared, keys, "left").join(found, keys, "left").join(days, "iso", "left")
    out = out.withColumn("per_week", F.col("n_signals") / (F.col("days") / 5.0)).drop("days")
    return stats.benjamini_hochberg(out, ["strategy"])


def null_comparison(observed: DataFrame, null: DataFrame, keys: list[str]) -> DataFrame:
    """Random means, lifts, deltas, quantiles and one-sided p-values per key, in one pass over the trials."""
    seen = ("hit_rate", "hit_favourable", "hit_closing", "currency_uplift_bps", "bad_push_rate")
    both = null.join(observed.select(*keys, *[F.col(m).alias(f"_{m}") for m in seen]), keys)
    base = both.groupBy(*keys).agg(
        *[F.avg(m).alias(f"random_{m}") for m in NULLS], F.expr("percentile(currency_uplift_bps, 0.025D)").alias("random_uplift_q025"), F.expr("percentile(currency_uplift_bps, 0.975D)").alias("random_uplift_q975"),
        *[F.first(f"_{m}").alias(m) for m in seen],
        stats.pvalue("currency_uplift_bps", "_currency_uplift_bps").alias("p_value"), stats.pvalue("hit_rate", "_hit_rate").alias("p_value_hit"),
    )
    lift = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return base.select(
        *keys, *[f"random_{m}" for m in NULLS], "random_uplift_q025", "random_uplift_q975", lift("hit_rate", "random_hit_rate").alias("hit_lift"),
        lift("hit_favourable", "random_hit_favourable").alias("hit_lift_favourable"), lift("hit_closing", "random_hit_closing").alias("hit_lift_closing"),
        (F.col("currency_uplift_bps") - F.col("random_currency_uplift_bps")).alias("currency_uplift_delta_bps"), (F.col("bad_push_rate") - F.col("random_bad_push_rate")).alias("bad_push_delta"),
        (F.col("currency_uplift_bps") - F.col("random_uplift_q975")).alias("uplift_over_null_q975_bps"), "p_value", "p_value_hit",
    )


def leaderboard(corridors: DataFrame, null: DataFrame, found: DataFrame) -> DataFrame:
    """One row per strategy, by cbsb_score: its uplift as a share of its own budget's ceiling, in percent."""
    rolled = cut_lineage(corridors.groupBy("strategy").agg(
        F.sum("n_signals").alias("total_signals"), F.count(F.lit(1)).alias("n_corridors"), *[stats.weighted_mean(m, "n_signals").alias(m) for m in (*WEIGHTED, "interval_cv", "series_share")],
        *[F.min(m).alias(f"{m}_worst_corridor") for m in WEIGHTED], F.avg("per_week").alias("per_week"), F.max("max_gap_days").alias("max_gap_days"),
        F.count_if(F.col("currency_uplift_bps") > 0).alias("corridors_positive"), F.count_if("significant_fdr").alias("corridors_significant"),
    ).withColumnRenamed("total_signals", "n_signals"))
    compared = cut_lineage(null_comparison(rolled, stats.pooled_null(null, ["strategy"], list(NULLS)), ["strategy"]))
    pooled = found.filter(F.col("iso") == POOLED).drop("iso")
    out = rolled.join(compared, "strategy", "left").join(pooled, "strategy", "left")
    told = F.create_map(*[F.lit(x) for s in STRATEGIES.values() for x in (s.name, f"{s.scenario}|{s.selection}")])[F.col("strategy")]
    out = out.withColumns({"scenario": F.substring_index(told, "|", 1), "selection": F.substring_index(told, "|", -1)})
    return out.withColumn("cbsb_score", F.when(F.col("ceiling_bps") > 0, F.col("currency_uplift_bps") / F.col("ceiling_bps") * 100)).orderBy(F.desc_nulls_last("cbsb_score"))


def evaluate_gates(board: DataFrame, gates=GATES) -> DataFrame:
    """strategy, gate, metric, value, passed; null where the metric is missing. ``gates`` is a short list."""

    def check(op: str, low: float, high: float | None, v: Column) -> Column:
        return {">=": v >= low, ">": v > low, "<=": v <= low, "<": v < low, "between": v.between(low, high if high is not None else low)}[op]

    rows = [F.struct(F.lit(n).alias("gate"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), check(op, a, b, F.col(m).cast("double")).alias("passed")) for n, m, op, a, b in gates]
    return board.select("strategy", F.explode(F.array(*rows)).alias("g")).select("strategy", "g.*")


def gate_matrix(checked: DataFrame, gates=GATES) -> DataFrame:
    """One column per gate in gate order."""
    return checked.groupBy("strategy").pivot("gate", [g[0] for g in gates]).agg(F.first("passed"))


def gate_verdicts(checked: DataFrame) -> DataFrame:
    """passed (of all gates), failed (their names in order) and the verdict per strategy."""
    names = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate"))))
    found = checked.groupBy("strategy").agg(F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n_gates"), F.array_join(names, ", ").alias("failed"))
    return found.withColumn("verdict", F.when(F.col("n_passed") == F.col("n_gates"), "pass").otherwise("fail"))


def horizon_table(panel: DataFrame, signals: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 10, 20), offset: int = 1) -> DataFrame:
    """Hit rate per strategy, by its own rule, at each horizon, as columns."""
    keys = signals.select("strategy", "iso", "quote_date").distinct()
    known = list(STRATEGIES.values())
    parts = []
    for h in horizons:
        outcomes = build_labels(panel, h, offset).filter("outcome_complete").select("iso", "quote_date", "held_favourable", "held_window_closing")
        parts.append(keys.join(outcomes, ["iso", "quote_date"]).select("strategy", F.lit(h).alias("h"), by_rule(known, "held_favourable", "held_window_closing").cast("int").alias("hit")))
    table = reduce(DataFrame.unionByName, parts).groupBy("strategy").pivot("h", list(horizons)).agg(F.avg("hit"))
    return table.withColumnsRenamed({str(h): f"hit_h{h}" for h in horizons})


def evaluated_days(panel: DataFrame, spec: BenchmarkSpec) -> DataFrame:
    """The labelled days with a whole outcome from the start of the evaluation on."""
    labels = build_labels(panel, spec.horizon, spec.execution_offset).filter("outcome_complete")
    return labels.filter(F.col("quote_date") >= F.lit(spec.eval_start).cast("date"))


def _per_week(n: Column, series: Column, days: Column) -> Column:
    """Signals a series and trading week: ``n`` over ``series`` series that have ``days`` days together."""
    return (n / series) / ((days / series) / 5.0)


def cadence_sweep(scores: DataFrame, strategies: list[Strategy], universe: DataFrame, cadences=CADENCES, spec: BenchmarkSpec = BenchmarkSpec()) -> DataFrame:
    """What each communication budget is worth: a row per budget and strategy, also without a signal.

    All budgets spend the same scores in one pass. Rhythm is measured within series and weighted by their signals.
    """
    policies = {label: PolicyConfig(window, most, cooldown, spec.policy.threshold_lookback, spec.policy.minimum_threshold_history) for label, window, most, cooldown in cadences}
    keys = ["cadence", "strategy"]
    floors = [F.when(F.col("strategy") == s.name, F.lit(s.minimum_score).cast("double")) for s in strategies if s.minimum_score is not None]
    rows = scores.withColumns({"minimum_score": F.coalesce(*floors, F.lit(None).cast("double")), "iso": F.concat_ws("|", "strategy", "iso")})
    sent = selected_by(rows, policies).select(F.col("policy").alias("cadence"), F.substring_index("iso", "|", 1).alias("strategy"), F.substring_index("iso", "|", -1).alias("iso"), "quote_date")
    done = cut_lineage(sent.join(universe, ["iso", "quote_date"]))
    size = universe.agg(F.count_distinct("iso").alias("_series"), F.count(F.lit(1)).alias("_days"))
    worth = done.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_signals"), F.avg("currency_gain_bps").alias("currency_uplift_bps"), F.avg(F.col("held_window_closing").cast("double")).alias("hit_closing"), F.avg(F.col("bad_push").cast("double")).alias("bad_push_rate")
    )
    rhythm = cadence(done, [*keys, "iso"]).filter("interval_cv is not null")
    paced = rhythm.groupBy(*keys).agg(stats.weighted_mean("interval_cv", "n_signals").alias("interval_cv"), stats.weighted_mean("series_share", "n_signals").alias("series_share"), F.max("max_gap_days").alias("max_gap_days"))
    budget = F.explode(F.array(*[F.struct(F.lit(a).alias("cadence"), F.lit(b).alias("window"), F.lit(c).alias("max_per_window"), F.lit(d).alias("cooldown")) for a, b, c, d in cadences]))
    grid = size.select("*", budget.alias("b")).select("_series", "_days", "b.*", F.explode(F.array(*[F.lit(s.name) for s in strategies])).alias("strategy"))
    out = grid.join(worth, keys, "left").join(paced, keys, "left").withColumn("n_signals", F.coalesce("n_signals", F.lit(0).cast("long")))
    return out.withColumn("per_week", _per_week(F.col("n_signals"), F.col("_series"), F.col("_days"))).drop("_series", "_days")


def swept_strategies(names: list[str]) -> list[Strategy]:
    """Those of the strategies whose scores the cadence sweep spends."""
    return [get_strategy(n) for n in ("oracle", "percentile", "utility_risk") if n in names]


def fold_assigned_signals(panel: DataFrame, names: list[str], spec: BenchmarkSpec, usd: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled signals of the strategies with ``held`` by each one's rule, all labelled days, both with their fold, and the folds."""
    labels = cut_lineage(build_labels(panel, spec.horizon, spec.execution_offset).filter("outcome_complete"))
    ranges = folds(panel.sparkSession, spec.eval_start, labels.agg(F.max("quote_date")), spec.fold_months)
    strategies = [get_strategy(n) for n in names]
    features = cut_lineage(compute_features(panel, usd))
    sent = emit(build_scores(panel, strategies, features, spec), strategies, spec.policy)
    signals = in_folds(sent.join(labels, ["iso", "quote_date"]), ranges)
    return signals.withColumn("held", by_rule(strategies, "held_favourable", "held_window_closing")), in_folds(labels, ranges), ranges


@dataclass
class BenchmarkResult:
    signals: DataFrame
    cells: DataFrame
    corridors: DataFrame
    leaderboard: DataFrame
    null: DataFrame
    panel: DataFrame
    spec: BenchmarkSpec

    @cached_property
    def gates(self) -> DataFrame:
        return evaluate_gates(self.leaderboard)

    @cached_property
    def horizons(self) -> DataFrame:
        return horizon_table(self.panel, self.signals, offset=self.spec.execution_offset)


def evaluated(panel: DataFrame, spec: BenchmarkSpec, names: list[str], usd: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signals, labelled days, cells) of the strategies: what all later tables are made of, kept as tables."""
    signals, universe, ranges = fold_assigned_signals(panel, names, spec, usd)
    signals, universe = cut_lineage(signals), cut_lineage(universe)
    return signals, universe, cut_lineage(all_cells(cells(signals, universe, "held"), names, universe, ranges))


def run_benchmark(panel: DataFrame, spec: BenchmarkSpec = BenchmarkSpec(), names: list[str] | None = None, usd: DataFrame | None = None) -> BenchmarkResult:
    """All tables of one evaluation; signals, labelled days, cells and the null feed several of them and are kept as tables."""
    names = names or ["percentile", "zscore", "drawdown", "oracle"]
    strategies = [get_strategy(n) for n in names]
    signals, universe, cell = evaluated(panel, spec, names, usd)
    drawn = universe.withColumns({"hit_favourable": F.col("held_favourable"), "hit_closing": F.col("held_window_closing"), "currency_uplift_bps": F.col("currency_gain_bps"), "bad_push_rate": F.col("bad_push")})
    # days are drawn with both hit rules, each strategy then reads its own
    null = stats.fold_null(drawn, cell, spec.random_trials, spec.seed, [m for m in NULLS if m != "hit_rate"])
    null = cut_lineage(null.withColumn("hit_rate", by_rule(strategies, "hit_favourable", "hit_closing")))
    days = universe.groupBy("iso").agg(F.countDistinct("quote_date").alias("days"))
    found = cut_lineage(tested(signals, spec))
    corridors = cut_lineage(per_corridor(cell, null, signals, found, days))
    return BenchmarkResult(signals, cell, corridors, cut_lineage(leaderboard(corridors, null, found)), null, panel, spec)


def prefixes(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Each series' rows up to each of its cuts (iso, cut), as a series of its own that is named iso@cut."""
    kept = rows.join(cuts, "iso").filter("quote_date <= cut")
    return kept.withColumn("iso", F.concat_ws("@", "iso", F.date_format("cut", "yyyy-MM-dd")))


def score_builders(spec: BenchmarkSpec = BenchmarkSpec()) -> dict:
    """The shipped scores that look back on outcomes, each as (panel, USD series) -> rows with ``score``."""

    def ridge(panel: DataFrame, usd: DataFrame | None) -> DataFrame:
        return walk_forward_ridge(compute_features(panel, usd), panel).withColumnRenamed("prediction", "score")

    def heads(panel: DataFrame, usd: DataFrame | None) -> DataFrame:
        return walk_forward_heads(panel, compute_features(panel, usd), UtilityRiskConfig(horizon=spec.horizon, execution_offset=spec.execution_offset))

    return {"tuned": lambda panel, usd: tuned_scores(panel), "ridge": ridge, "utility_risk": heads}


def audit_no_lookahead(panel: DataFrame, usd: DataFrame | None, builders: dict, spec: BenchmarkSpec = BenchmarkSpec(), n_dates: int = 2, tolerance: float = 1e-9) -> DataFrame:
    """score_name, iso, cut, historical_score, asof_score, abs_difference, matched, reason.

    Quotes after a cut are deleted, not masked: the panel and the USD series are cut at evenly spaced dates of each
    series' evaluated scores, and all prefixes are scored in one plan per score.
    """
    usd = panel.filter("iso = 'USD'") if usd is None else usd
    parts = []
    for name, build in builders.items():
        full = cut_lineage(build(panel, usd).filter("score is not null").select("iso", "quote_date", "score"))
        evaluated = full.filter(F.col("quote_date") >= F.lit(spec.eval_start).cast("date"))
        cuts = cut_lineage(evenly_spaced(evaluated, n_dates).select("iso", F.col("quote_date").alias("cut")).distinct())
        context = prefixes(usd, cuts.select(F.lit("USD").alias("iso"), "cut").distinct())
        live = build(prefixes(panel, cuts), context).select(F.substring_index("iso", "@", 1).alias("iso"), F.substring_index("iso", "@", -1).cast("date").alias("cut"), "quote_date", F.col("score").alias("asof_score"))
        then = full.select("iso", F.col("quote_date").alias("cut"), F.col("score").alias("historical_score"))
        both = cuts.join(then, ["iso", "cut"]).join(live.filter("quote_date = cut").drop("quote_date"), ["iso", "cut"], "left")
        gap = F.abs(F.col("asof_score") - F.col("historical_score"))
        reason = F.when(F.col("asof_score").isNull(), "score missing in one of the runs").otherwise("")
        parts.append(both.select(F.lit(name).alias("score_name"), "iso", "cut", "historical_score", "asof_score", gap.alias("abs_difference"), F.coalesce(gap < tolerance, F.lit(False)).alias("matched"), reason.alias("reason")))
    return reduce(DataFrame.unionByName, parts)


def lambda_sweep(heads: DataFrame, universe: DataFrame, policy: PolicyConfig, grid: tuple[float, ...] = (0.0, 0.5, 1.0, 2.0, 3.0, 5.0)) -> DataFrame:
    """What each price of risk is worth, a row each, also without a signal; the heads' scores are projected again, not fitted.

    A day is sent only if it beats the base rates (a floor of 0).
    """
    variants = {f"utility_risk_lam{lam:g}": lam for lam in grid}
    strategies = [Strategy(name, "model", "favourable_now", str(lam), minimum_score=0.0) for name, lam in variants.items()]
    sent = emit(_stacked(heads, {s.name: net_score(float(s.family)) for s in strategies}), strategies, policy).join(universe, ["iso", "quote_date"])
    mean = lambda c: F.avg(F.col(c).cast("double"))
    worth = sent.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_signals"), mean("held_favourable").alias("hit_rate"), mean("currency_gain_bps").alias("currency_uplift_bps"), mean("window_advantage_bps").alias("window_advantage_bps"),
        mean("bad_push").alias("bad_push_rate"), mean("regret_bps").alias("regret_bps"),
    )
    size = universe.agg(F.count_distinct("iso").alias("_series"), F.count(F.lit(1)).alias("_days"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("strategy"), F.lit(float(lam)).alias("lam")) for name, lam in variants.items()]))
    out = size.select("*", each.alias("v")).select("_series", "_days", "v.*").join(worth, "strategy", "left").withColumn("n_signals", F.coalesce("n_signals", F.lit(0).cast("long")))
    return out.withColumn("per_week", _per_week(F.col("n_signals"), F.col("_series"), F.col("_days"))).drop("_series", "_days", "strategy")


def evenly_spaced(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows of each series at even positions from the first to the last."""
    w = Window.partitionBy("iso")
    df = rows.withColumns({"_at": F.row_number().over(o()) - 1, "_n": F.count(F.lit(1)).over(w)})
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(float(max(1, n - 1)))))
    return df.filter(F.array_contains(wanted, F.col("_at").cast("long"))).drop("_at", "_n")

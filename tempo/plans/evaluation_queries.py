"""Queries over labels, policy, evaluation statistics, indicators, simulation and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempo.functions import windows as W
from tempo.functions.storage import cut_lineage, free_folder
from tempo.operators import backtest as K
from tempo.operators import benchmark as B
from tempo.operators import charts as H
from tempo.operators import evaluation as E
from tempo.operators import indicators as I
from tempo.operators import labels as L
from tempo.operators import models as M
from tempo.operators import policy as A
from tempo.operators import signals as S
from tempo.operators import simulate as U
from tempo.operators import stand as D
from tempo.operators import stats as T
from tempo.operators import tuning as G
from tempo.plans import service as C
from tempo.plans import sql as Q
from tempo.plans.panel_queries import V, features, on_p, p1, r, rounded, table, usd
from tempo.sources import panel as N

QUERIES = {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


_LAB = Q.labels(10, 1)
_NUMBERS = ("exec_rate", "fwd_advantage_bps", "fwd_median_advantage_bps", "window_advantage_bps", "currency_gain_bps", "adverse_bps", "regret_bps")
_FLAGS = ("bad_push", "is_local_min", "held_favourable", "held_window_closing")


@query("labels_h10", on_p("SELECT iso, quote_date, exec_date, label_available_on, " + ", ".join(r(c, c, 6 if c == "exec_rate" else 4) for c in _NUMBERS) + ", " + ", ".join(f"CAST({c} AS INT) AS {c}" for c in _FLAGS) + ", CAST(ok AS INT) AS outcome_complete FROM lab", _LAB))
def _(s, d):
    df = L.build_labels(p1(s, d))
    return df.select("iso", "quote_date", "exec_date", "label_available_on", *[F.round(c, 6 if c == "exec_rate" else 4).alias(c) for c in _NUMBERS], *[F.col(c).cast("int").alias(c) for c in (*_FLAGS, "outcome_complete")])


_OUT = f"ow AS (SELECT *, count(v) {Q.over(1, 20)} AS n, quantile_cont(v, 0.5) {Q.over(1, 20)} AS mid, min(v) {Q.over(1, 20)} AS low, lead(available_on, 20) OVER ({Q.O}) AS kn FROM p)"


@query("outcomes_h20", on_p(f"""SELECT iso, quote_date, {r('CASE WHEN n = 20 THEN mid END', 'future_median')}, {r('CASE WHEN n = 20 THEN low END', 'future_minimum')}, {r('CASE WHEN n = 20 THEN (mid - v) / v * 10000 END', 'advantage_bps', 4)},
CAST(CASE WHEN n = 20 THEN low < v * (1 - 30.0::DOUBLE / 10000) END AS INT) AS early_send, {r('CASE WHEN n = 20 THEN greatest(0.0, (v - low) / v * 10000) END', 'regret_bps', 4)}, CASE WHEN n = 20 THEN kn END AS outcome_available_on, CAST(n = 20 AS INT) AS outcome_complete FROM ow""", _OUT))
def _(s, d):
    df = L.build_outcomes(p1(s, d))
    six, four = ("future_median", "future_minimum"), ("advantage_bps", "regret_bps")
    return df.select("iso", "quote_date", *[F.round(c, 6).alias(c) for c in six], *[F.round(c, 4).alias(c) for c in four], F.col("early_send").cast("int").alias("early_send"), "outcome_available_on", F.col("outcome_complete").cast("int").alias("outcome_complete"))


@query("ridge_target", on_p(f"SELECT iso, quote_date, {r('(mid - v) / v', 'target', 8)}, kn AS target_available_on FROM ow WHERE n = 20", _OUT))
def _(s, d):
    return L.make_target(p1(s, d), 20).select("iso", "quote_date", F.round("target", 8).alias("target"), "target_available_on")


_HS = (1, 3, 5, 10, 20)
_RANK = f"rk AS ({Q.ranked('p', 'v', 90, 20, 'k')}), ev AS (SELECT iso, quote_date FROM rk WHERE k <= 0.1)"


def _events(s, d):
    return p1(s, d).withColumn("k", W.rolling_rank(V, 90, 20)).filter("k <= 0.1")


@query("hit_rates_by_h", on_p("SELECT ev.iso, " + ", ".join(r(f"avg(CASE WHEN l{h}.ok THEN CAST(l{h}.held_favourable AS INT) END)", f"hit_h{h}") for h in _HS) + " FROM ev " + " ".join(f"JOIN l{h} USING (iso, quote_date)" for h in _HS) + " GROUP BY ev.iso", _RANK, *[Q.labels(h, 1, name=f"l{h}") for h in _HS]))
def _(s, d):
    return rounded(L.horizon_hit_rates(p1(s, d), _events(s, d), _HS), *[f"hit_h{h}" for h in _HS], keep=("iso",))


_KN = f"kn AS (SELECT *, max(coalesce(label_available_on, DATE '9999-12-31')) {Q.over('UNBOUNDED PRECEDING', 0)} AS known FROM lab), pk AS (SELECT a.iso, a.quote_date, (SELECT count(*) FROM kn b WHERE b.iso = a.iso AND b.known <= a.available_on) AS k FROM kn a)"


@query("train_prefix_k", on_p("SELECT iso, quote_date, k FROM pk", _LAB, _KN))
def _(s, d):
    return L.matured_before(L.build_labels(p1(s, d))).select("iso", "quote_date", "k")


_CAND = G.WINDOWS


def _candidates() -> str:
    """CTEs from lab to cs (stacked) and cr (ranked): 1 - rank over each window, as x<place> in cl."""
    chain, source = [], "lab"
    for i, n in enumerate(_CAND):
        chain.append(f"c{i} AS ({Q.ranked(source, 'v', n, max(20, n // 4), f'r{n}')})")
        source = f"c{i}"
    stacked = " UNION ALL ".join(f"SELECT iso, 'window={n}' AS candidate, 1 - r{n} AS x, currency_gain_bps AS y FROM {source}" for n in _CAND)
    rank = lambda c: f"rank() OVER (PARTITION BY iso, candidate ORDER BY {c}) + (count(*) OVER (PARTITION BY iso, candidate, {c}) - 1) / 2.0 AS r{c}"
    return ", ".join((*chain, f"cl AS (SELECT * FROM {source})", f"cs AS ({stacked})", f"cr AS (SELECT *, {rank('x')}, {rank('y')} FROM cs WHERE x IS NOT NULL AND y IS NOT NULL)"))


_SP = _candidates()


@query("spearman_by_candidate", on_p(f"SELECT iso, candidate, {r('CASE WHEN count(*) >= 30 THEN corr(rx, ry) END', 'rho')} FROM cr GROUP BY iso, candidate", _LAB, _SP))
def _(s, d):
    df = G.percentile_candidates(L.build_labels(p1(s, d)), _CAND)
    stacked = F.explode(F.array(*[F.struct(F.lit(f"window={n}").alias("candidate"), F.col(f"`window={n}`").alias("x")) for n in _CAND]))
    pairs = df.select("iso", F.col("currency_gain_bps").alias("y"), stacked.alias("c")).select("iso", "c.candidate", "c.x", "y")
    return rounded(G.with_spearman(pairs, ["iso", "candidate"]), "rho", keep=("iso", "candidate"))


def _tuned(rows: str, names: int, score) -> str:
    """CTEs from ro (iso, quote_date, k, pos, y and the scores) to tu and be: refits, their training rows, the best candidate.

    A refit without a correlation would be tried again on the next row; these data have none.
    """
    scores = " UNION ALL ".join(f"SELECT iso, pos, {i} AS idx, {score(i)} AS x, y FROM ro" for i in range(names))
    return f"""ro AS ({rows}),
rf AS (SELECT *, min(pos) FILTER (k >= 500) OVER (PARTITION BY iso) AS p0 FROM ro), tu AS (SELECT *, CASE WHEN k >= 500 THEN (pos - p0) // 21 END AS turn FROM rf),
ft AS (SELECT iso, turn, k, greatest(0, k - 750) AS low FROM tu WHERE turn IS NOT NULL AND (pos - p0) % 21 = 0),
tr AS (SELECT ft.iso, ft.turn, idx, x, y FROM ft JOIN ({scores}) q ON q.iso = ft.iso AND q.pos >= low AND q.pos < ft.k WHERE x IS NOT NULL AND y IS NOT NULL),
tk2 AS (SELECT *, rank() OVER (PARTITION BY iso, turn, idx ORDER BY x) + (count(*) OVER (PARTITION BY iso, turn, idx, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY iso, turn, idx ORDER BY y) + (count(*) OVER (PARTITION BY iso, turn, idx, y) - 1) / 2.0 AS ry FROM tr),
rh AS (SELECT iso, turn, idx, round(corr(rx, ry), 12) AS rho FROM tk2 GROUP BY iso, turn, idx HAVING count(*) >= 30), be AS (SELECT iso, turn, idx FROM (SELECT *, row_number() OVER (PARTITION BY iso, turn ORDER BY rho DESC, idx) AS n FROM rh) WHERE n = 1)"""


_TUNE = _tuned("SELECT cl.*, currency_gain_bps AS y, k, row_number() OVER (PARTITION BY cl.iso ORDER BY cl.quote_date) - 1 AS pos FROM cl JOIN pk ON pk.iso = cl.iso AND pk.quote_date = cl.quote_date", len(_CAND), lambda i: f"1 - r{_CAND[i]}")
_PICK = lambda form: "CASE idx " + " ".join(f"WHEN {i} THEN {form.format(n)}" for i, n in enumerate(_CAND)) + " END"


@query("tuned_percentile", on_p(f"SELECT * FROM (SELECT tu.iso, quote_date, {_PICK("'window={}'")} AS chosen, {r(_PICK('1 - r{}'), 'score')} FROM tu JOIN be ON be.iso = tu.iso AND be.turn = tu.turn) WHERE score IS NOT NULL", _LAB, _KN, _SP, _TUNE))
def _(s, d):
    found = G.calibrated(G.percentile_candidates(p1(s, d), _CAND), [f"window={n}" for n in _CAND])
    return found.select("iso", "quote_date", "chosen", F.round("score", 6).alias("score"))


def _span_tuning(p: str = Q.P) -> str:
    """CTEs up to tn: the tuned z-score, the deviation from its mean and the chosen span of every row."""
    chain, source = [], "p"
    for n in G.SPANS:
        chain.append(Q.zscore(source, n, f"y{n}"))
        source = f"y{n}"
    rows = "SELECT lab.*, currency_gain_bps AS y, k, row_number() OVER (PARTITION BY lab.iso ORDER BY lab.quote_date) - 1 AS pos FROM lab JOIN pk ON pk.iso = lab.iso AND pk.quote_date = lab.quote_date"
    pick = lambda form: "CASE idx " + " ".join(f"WHEN {i} THEN {form.format(n)}" for i, n in enumerate(G.SPANS)) + " END"
    tuned = f"tn AS (SELECT tu.iso, quote_date, available_on, v, idx, {pick('-z_{}')} AS plain, {pick('(v / m_{} - 1) * 100')} AS dev, {pick("'span={}'")} AS chosen, {pick('{}')} AS span FROM tu JOIN be ON be.iso = tu.iso AND be.turn = tu.turn)"
    return ", ".join((p, *chain, Q.labels(10, 1, source), _KN, _tuned(rows, len(G.SPANS), lambda i: f"-z_{G.SPANS[i]}"), tuned))


@query("tuned_choice", f"WITH {_span_tuning()} SELECT iso, quote_date, chosen, {r('plain', 'score')} FROM tn WHERE plain IS NOT NULL")
def _(s, d):
    return G.calibrated(G.zscore_candidates(p1(s, d)), [f"span={n}" for n in G.SPANS]).select("iso", "quote_date", "chosen", F.round("score", 6).alias("score"))


# Policy over the percentile score: thresholds by window, decisions by a recursion over positions

_CONF = A.PolicyConfig(cooldown_observations=1, minimum_score=0.8)
_LEVELS = "[" + ", ".join(f"{q!r}" for q in _CONF.levels()) + "]"
def _policy(floor: str) -> str:
    """CTEs from sc (iso, quote_date, available_on, score) to th: thresholds by number of free slots."""
    return f"""pw AS (SELECT *, {Q.week('available_on')} AS window_id, row_number() OVER ({Q.O}) - 1 AS pos FROM sc),
ps AS (SELECT *, row_number() OVER (PARTITION BY iso, window_id ORDER BY quote_date) AS seen, count(score) {Q.over(-250, -1)} AS hist, quantile_cont(score, {_LEVELS}) {Q.over(-250, -1)} AS q FROM pw),
pt AS (SELECT *, greatest(1, 5 - seen + 1) AS rest FROM ps),
th AS (SELECT *, [CASE WHEN hist >= 20 THEN greatest(q[rest], {floor}) END, CASE WHEN hist >= 20 THEN greatest(q[5 + rest], {floor}) END, CASE WHEN hist >= 20 THEN greatest(q[10 + rest], {floor}) END] AS t FROM pt)"""


_POL = f"rk AS ({Q.ranked('p', 'v', 90, 20, 'k')}), sc AS (SELECT iso, quote_date, available_on, v, 1 - k AS score FROM rk WHERE k IS NOT NULL), " + _policy("0.8")


@query("policy_thresholds", on_p(f"SELECT iso, quote_date, window_id, seen, hist AS score_history_count, {r('t[1]', 't0')}, {r('t[2]', 't1')}, {r('t[3]', 't2')} FROM th", _POL))
def _(s, d):
    df = A.with_thresholds(_scores(s, d), _CONF)
    return df.select("iso", "quote_date", "window_id", F.col("seen").cast("long").alias("seen"), "score_history_count", *[F.round(F.get("thresholds", i), 6).alias(f"t{i}") for i in range(3)])


def _scores(s, d):
    return p1(s, d).withColumn("score", 1 - W.rolling_rank(V, 90, 20))


_DEC = """dec AS (
  SELECT iso, CAST(-1 AS BIGINT) AS pos, CAST('' AS VARCHAR) AS win, 0 AS used, CAST(NULL AS BIGINT) AS last, CAST('' AS VARCHAR) AS reason, CAST(NULL AS DATE) AS quote_date FROM (SELECT DISTINCT iso FROM th)
  UNION ALL
  SELECT iso, pos, win, CASE WHEN reason = 'selected' THEN used + 1 ELSE used END, CASE WHEN reason = 'selected' THEN pos ELSE last END, reason, quote_date FROM (
    SELECT iso, pos, win, used, last, quote_date, CASE WHEN hist < 20 THEN 'threshold_warmup' WHEN used >= 2 THEN 'window_budget_exhausted' WHEN last IS NOT NULL AND 1 - (pos - last) + 1 > 0 THEN 'cooldown'
      WHEN score < t[2 - used + 1] THEN 'below_threshold' ELSE 'selected' END AS reason
    FROM (SELECT th.iso, th.pos, th.window_id AS win, CASE WHEN th.window_id = dec.win THEN dec.used ELSE 0 END AS used, dec.last, th.quote_date, th.hist, th.score, th.t FROM dec JOIN th ON th.iso = dec.iso AND th.pos = dec.pos + 1)))"""


def _recursive(body: str) -> str:
    return f"WITH RECURSIVE {Q.P}, {_POL}, {_DEC} {body}"


@query("policy_decisions", _recursive("SELECT iso, quote_date, win AS window_id, CAST(reason = 'selected' AS INT) AS decision, reason AS decision_reason FROM dec WHERE pos >= 0"))
def _(s, d):
    return A.apply_policy(_scores(s, d), _CONF).select("iso", "quote_date", "window_id", F.col("decision").cast("int").alias("decision"), "decision_reason")


@query("policy_reasons_count", _recursive("SELECT iso, reason AS decision_reason, count(*) AS n FROM dec WHERE pos >= 0 GROUP BY iso, reason"))
def _(s, d):
    return A.apply_policy(_scores(s, d), _CONF).groupBy("iso", "decision_reason").agg(F.count(F.lit(1)).alias("n"))


_TOP = f"tk AS (SELECT iso, quote_date, score FROM (SELECT *, row_number() OVER (PARTITION BY iso, {Q.week('quote_date')} ORDER BY score DESC, quote_date) AS n FROM (SELECT iso, quote_date, 1 - k AS score FROM rk WHERE k IS NOT NULL)) WHERE n <= 2)"
_RK = f"rk AS ({Q.ranked('p', 'v', 90, 20, 'k')})"


@query("weekly_topk", on_p(f"SELECT iso, quote_date, {r('score', 'score')} FROM tk", _RK, _TOP))
def _(s, d):
    return rounded(A.best_per_window(_scores(s, d)), "score")


@query("cooldown_emission")
def _(s, d):
    return rounded(A.cooldown_emission(_scores(s, d).withColumnRenamed("score", "prediction")), "prediction")


# Evaluation of the weekly best days as a strategy

_FOLD = "fo AS (SELECT CAST(b AS DATE) AS fold_start, CAST(least(CAST(b + INTERVAL 6 MONTH AS DATE) - 1, e) AS DATE) AS fold_end FROM (SELECT unnest(generate_series(DATE '1997-01-01', e, INTERVAL 6 MONTH)) AS b, e FROM (SELECT max(quote_date) AS e FROM lab WHERE ok))), fd AS (SELECT *, strftime(fold_start, '%Y-%m') || '..' || strftime(fold_end, '%Y-%m') AS fold FROM fo)"
_UNI = "un AS (SELECT lab.*, fold FROM lab JOIN fd ON quote_date BETWEEN fold_start AND fold_end WHERE ok), sg AS (SELECT un.* FROM un JOIN tk USING (iso, quote_date))"
_EVAL = (_RK, _TOP, _LAB, _FOLD, _UNI)
_CELL = """ce0 AS (SELECT iso, fold, count(*) AS n_signals, avg(CAST(held_favourable AS INT)) AS hit_rate, avg(CAST(held_window_closing AS INT)) AS hit_closing, avg(currency_gain_bps) AS currency_uplift_bps, avg(window_advantage_bps) AS window_advantage_bps,
avg(regret_bps) AS regret_bps, avg(CAST(bad_push AS INT)) AS bad_push_rate FROM sg GROUP BY iso, fold),
bs AS (SELECT iso, fold, currency_gain_bps AS g, row_number() OVER (PARTITION BY iso, fold ORDER BY currency_gain_bps DESC, quote_date) AS place FROM un WHERE currency_gain_bps IS NOT NULL),
ce AS (SELECT ce0.*, (SELECT avg(g) FROM bs WHERE bs.iso = ce0.iso AND bs.fold = ce0.fold AND place <= n_signals) AS ceiling_bps FROM ce0)"""
_CELLS = ("hit_rate", "hit_closing", "currency_uplift_bps", "window_advantage_bps", "regret_bps", "bad_push_rate", "ceiling_bps")


def _evaluated(s, d):
    panel = p1(s, d)
    labels = L.build_labels(panel).filter("outcome_complete")
    ranges = B.folds(s, "1997-01-01", labels.agg(F.max("quote_date")))
    universe = B.in_folds(labels, ranges)
    sent = A.best_per_window(_scores(s, d)).select("iso", "quote_date", F.lit("weekly").alias("strategy"))
    return universe.join(sent, ["iso", "quote_date"]), universe, ranges


@query("folds", on_p("SELECT fold, fold_start, fold_end FROM fd", _LAB, _FOLD))
def _(s, d):
    return _evaluated(s, d)[2]


@query("fold_assign", on_p("SELECT iso, quote_date, fold FROM un", *_EVAL))
def _(s, d):
    return _evaluated(s, d)[1].select("iso", "quote_date", "fold")


@query("fold_cells", on_p("SELECT iso, fold, n_signals, " + ", ".join(r(c, c, 4) for c in _CELLS) + " FROM ce", *_EVAL, _CELL))
def _(s, d):
    signals, universe, _ = _evaluated(s, d)
    return rounded(B.cells(signals, universe, "held_favourable"), *_CELLS, digits=4, keep=("iso", "fold", "n_signals"))


@query("weighted_rollup", on_p("SELECT iso, CAST(sum(n_signals) AS BIGINT) AS n_signals, " + ", ".join(r(f"sum({c} * n_signals) FILTER ({c} IS NOT NULL) / sum(n_signals) FILTER ({c} IS NOT NULL)", c, 4) for c in _CELLS) + " FROM ce GROUP BY iso", *_EVAL, _CELL))
def _(s, d):
    signals, universe, _ = _evaluated(s, d)
    rolled = B.cells(signals, universe, "held_favourable").groupBy("iso").agg(F.sum("n_signals").alias("n"), *[T.weighted_mean(c, "n_signals").alias(c) for c in _CELLS])
    return rounded(rolled.withColumnRenamed("n", "n_signals"), *_CELLS, digits=4, keep=("iso", "n_signals"))


_GAP = f"gp AS (SELECT *, date_diff('day', {Q.lag('quote_date')}, quote_date) AS gap FROM sg)"


@query("cadence_cv_gap", on_p(f"SELECT iso, count(*) AS n_signals, {r('stddev_samp(gap) / avg(gap)', 'interval_cv')}, max(gap) AS max_gap_days, {r('avg(CAST(gap <= 5 AS INT))', 'series_share')} FROM gp GROUP BY iso", *_EVAL, _GAP))
def _(s, d):
    df = B.cadence(_evaluated(s, d)[0], ["iso"])
    return df.select("iso", "n_signals", F.round("interval_cv", 6).alias("interval_cv"), F.col("max_gap_days").cast("long").alias("max_gap_days"), F.round("series_share", 6).alias("series_share"))


@query("pooled_clustering", on_p(f"SELECT {r('count(*) FILTER (gap <= 5) / count(*)::DOUBLE', 'series_share')}, {r('stddev_samp(gap) / avg(gap)', 'interval_cv')} FROM gp", *_EVAL, _GAP))
def _(s, d):
    return rounded(B.pooled_clustering(_evaluated(s, d)[0]), "series_share", "interval_cv", keep=())


@query("frequency", on_p(f"SELECT iso, n AS n_signals, {r('n / (days / 5.0)', 'per_week')}, {r('n / (days / 21.0)', 'per_month')} FROM (SELECT iso, count(*) AS n FROM sg GROUP BY iso) JOIN (SELECT iso, count(DISTINCT quote_date) AS days FROM p GROUP BY iso) USING (iso)", *_EVAL))
def _(s, d):
    return rounded(B.frequency(_evaluated(s, d)[0], p1(s, d)), "per_week", "per_month", keep=("iso", "n_signals"))


_TRIALS, _SEED = 500, 7
_NULL = f"""nu AS (SELECT iso, fold, trial, n_signals, avg(CAST(held_favourable AS INT)) AS hit_rate, avg(currency_gain_bps) AS currency_uplift_bps, avg(CAST(bad_push AS INT)) AS bad_push_rate FROM (
  SELECT un.*, trial, n_signals, row_number() OVER (PARTITION BY un.iso, un.fold, trial ORDER BY {Q.md5_key(_SEED, 'trial', 'un.iso', 'un.quote_date')}) AS place FROM un JOIN ce USING (iso, fold), (SELECT unnest(range({_TRIALS})) AS trial)) WHERE place <= n_signals GROUP BY ALL),
ni AS (SELECT iso, trial, sum(hit_rate * n_signals) / sum(n_signals) AS hit_rate, sum(currency_uplift_bps * n_signals) FILTER (currency_uplift_bps IS NOT NULL) / sum(n_signals) FILTER (currency_uplift_bps IS NOT NULL) AS currency_uplift_bps FROM nu GROUP BY iso, trial),
ob AS (SELECT iso, sum(currency_uplift_bps * n_signals) FILTER (currency_uplift_bps IS NOT NULL) / sum(n_signals) FILTER (currency_uplift_bps IS NOT NULL) AS o, sum(hit_rate * n_signals) / sum(n_signals) AS oh FROM ce GROUP BY iso),
pv AS (SELECT iso, (count(*) FILTER (round(currency_uplift_bps, 9) >= round(o, 9)) + 1) / (count(*) + 1)::DOUBLE AS p_value, count(*) AS draws FROM ni JOIN ob USING (iso) GROUP BY iso),
ph AS (SELECT iso, (count(*) FILTER (round(hit_rate, 9) >= round(oh, 9)) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM ni JOIN ob USING (iso) GROUP BY iso)"""


def _nulls(s, d):
    signals, universe, _ = _evaluated(s, d)
    cell = B.cells(signals, universe, "held_favourable")
    named = universe.withColumns({"hit_rate": F.col("held_favourable"), "currency_uplift_bps": F.col("currency_gain_bps")})
    null = T.pooled_null(T.fold_null(named, cell, _TRIALS, _SEED, ["hit_rate", "currency_uplift_bps"]), ["iso"], ["hit_rate", "currency_uplift_bps"])
    observed = cell.groupBy("iso").agg(*[T.weighted_mean(c, "n_signals").alias(c) for c in ("hit_rate", "currency_uplift_bps")])
    return null, observed


@query("matched_null", on_p(f"SELECT iso, trial, {r('hit_rate', 'hit_rate')}, {r('currency_uplift_bps', 'currency_uplift_bps', 4)} FROM ni", *_EVAL, _CELL, _NULL))
def _(s, d):
    return _nulls(s, d)[0].select("iso", F.col("trial").cast("long").alias("trial"), F.round("hit_rate", 6).alias("hit_rate"), F.round("currency_uplift_bps", 4).alias("currency_uplift_bps"))


@query("perm_pvalue", on_p(f"SELECT iso, {r('p_value', 'p_value')}, draws FROM pv", *_EVAL, _CELL, _NULL))
def _(s, d):
    return rounded(T.permutation_pvalue(*_nulls(s, d), ["iso"], "currency_uplift_bps"), "p_value", keep=("iso", "draws"))


_BH = """bt AS (SELECT 'uplift' AS metric, iso, p_value FROM pv UNION ALL SELECT 'hit', iso, p_value FROM ph), br AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p_value, iso) AS rk2, count(*) OVER (PARTITION BY metric) AS m FROM bt),
bq AS (SELECT metric, iso, least(1.0, min(p_value * m / rk2) OVER (PARTITION BY metric ORDER BY rk2 DESC ROWS UNBOUNDED PRECEDING)) AS q FROM br)"""


@query("bh_qvalues", on_p(f"SELECT metric, iso, {r('q', 'q_value')}, q <= 0.05 AS significant_fdr FROM bq", *_EVAL, _CELL, _NULL, _BH))
def _(s, d):
    null, observed = _nulls(s, d)
    tests = [T.permutation_pvalue(null, observed, ["iso"], c).select(F.lit(n).alias("metric"), "iso", "p_value") for n, c in (("uplift", "currency_uplift_bps"), ("hit", "hit_rate"))]
    return T.benjamini_hochberg(tests[0].unionByName(tests[1]), ["metric"]).select("metric", "iso", F.round("q_value", 6).alias("q_value"), "significant_fdr")


@query("null_histogram", on_p("""SELECT iso, CAST(CASE WHEN hi > lo THEN least(12, floor((x - lo) / (hi - lo) * 12) + 1) ELSE 1 END AS INT) AS bin, count(*) AS n
FROM (SELECT iso, currency_uplift_bps AS x, min(currency_uplift_bps) OVER (PARTITION BY iso) AS lo, max(currency_uplift_bps) OVER (PARTITION BY iso) AS hi FROM ni) GROUP BY 1, 2""", *_EVAL, _CELL, _NULL))
def _(s, d):
    return T.histogram(_nulls(s, d)[0], ["iso"], "currency_uplift_bps", 12)


_NW = """nx AS (SELECT iso, currency_gain_bps AS x, row_number() OVER (PARTITION BY iso ORDER BY quote_date) AS at, count(*) OVER (PARTITION BY iso) AS n, currency_gain_bps - avg(currency_gain_bps) OVER (PARTITION BY iso) AS d FROM sg WHERE currency_gain_bps IS NOT NULL),
nl AS (SELECT a.iso, a.n, l AS lag, sum(a.d * b.d) / a.n AS cov FROM nx a, unnest(range(CAST(floor(4 * pow(a.n / 100.0, 2.0 / 9)) AS BIGINT) + 1)) AS t(l), nx b WHERE b.iso = a.iso AND b.at = a.at - l GROUP BY a.iso, a.n, l),
nv AS (SELECT iso, n, sum(CASE WHEN lag = 0 THEN cov ELSE 2 * (1 - lag / (floor(4 * pow(n / 100.0, 2.0 / 9)) + 1)) * cov END) AS var FROM nl GROUP BY iso, n)"""


@query("newey_west", on_p(f"SELECT iso, n, {r('m', 'mean', 4)}, {r('sqrt(var / n)', 'se', 4)}, {r('m / sqrt(var / n)', 't_stat', 4)} FROM nv JOIN (SELECT iso, avg(x) AS m FROM nx GROUP BY iso) USING (iso)", *_EVAL, _NW))
def _(s, d):
    return rounded(T.newey_west(_evaluated(s, d)[0], ["iso"], "currency_gain_bps", "quote_date"), "mean", "se", "t_stat", digits=4, keep=("iso", "n"))


_BOOT = f"""bv AS (SELECT iso, window_advantage_bps AS x, row_number() OVER (PARTITION BY iso ORDER BY quote_date) - 1 AS place, count(*) OVER (PARTITION BY iso) AS n FROM sg WHERE window_advantage_bps IS NOT NULL),
bp AS (SELECT iso, n, least(10, n) AS w, trial, unnest(range(CAST(ceil(n / least(10, n)::DOUBLE) AS BIGINT))) AS blk FROM (SELECT DISTINCT iso, n FROM bv), (SELECT unnest(range(1000)) AS trial)),
bd AS (SELECT iso, trial, start_at + i AS place FROM (SELECT *, CAST('0x' || substr({Q.md5_key(_SEED, 'iso', 'trial', 'blk')}, 1, 12) AS BIGINT) % (n - w + 1) AS start_at, unnest(range(w)) AS i FROM bp) WHERE blk * w + i < n),
bm AS (SELECT iso, trial, avg(x) AS m FROM bd JOIN bv USING (iso, place) GROUP BY iso, trial), bc AS (SELECT iso, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM bm GROUP BY iso)"""


@query("block_bootstrap", on_p(f"SELECT iso, {r('ci_low', 'ci_low', 4)}, {r('ci_high', 'ci_high', 4)} FROM bc", *_EVAL, _BOOT))
def _(s, d):
    return rounded(T.block_bootstrap(_evaluated(s, d)[0], ["iso"], "window_advantage_bps", "quote_date", 10, 1000, _SEED), "ci_low", "ci_high", digits=4, keep=("iso",))


# The seven gates over the weekly best days; each series stands for a strategy
_GATE = """nb AS (SELECT iso, fold, trial, n_signals, hit_rate, currency_uplift_bps, bad_push_rate FROM nu), gr AS (SELECT iso, sum(hit_rate * n_signals) / sum(n_signals) AS rh, sum(bad_push_rate * n_signals) / sum(n_signals) AS rb FROM nb GROUP BY iso, trial),
gm AS (SELECT iso, avg(rh) AS random_hit, avg(rb) AS random_bad FROM gr GROUP BY iso), gs AS (SELECT iso, sum(bad_push_rate * n_signals) / sum(n_signals) AS bad FROM ce GROUP BY iso),
gd AS (SELECT iso, count(DISTINCT quote_date) AS days FROM un GROUP BY iso), gg AS (SELECT iso, count(*) AS n, stddev_samp(gap) / avg(gap) AS cv, max(gap) AS mg FROM gp GROUP BY iso),
gv AS (SELECT iso AS strategy, gate, value, ok FROM (SELECT iso, oh / random_hit AS lift, ci_low, p_value, n / (days / 5.0) AS pw, cv, CAST(mg AS DOUBLE) AS mg, bad - random_bad AS bd FROM ob JOIN gm USING (iso) JOIN gs USING (iso) JOIN pv USING (iso) JOIN bc USING (iso) JOIN gg USING (iso) JOIN gd USING (iso)) g,
LATERAL (VALUES ('G1_lift', lift, lift >= 1.0), ('G2_advantage', ci_low, ci_low > 0), ('G3_significance', p_value, p_value <= 0.05), ('G4_frequency', pw, pw BETWEEN 1.0 AND 2.0), ('G5_evenness', cv, cv <= 1.0), ('G6_gap', mg, mg <= 75), ('G7_risk', bd, bd <= 0)) AS t(gate, value, ok))"""
_GATED = (*_EVAL, _CELL, _NULL, _GAP, _BOOT, _GATE)


def _gated(s, d):
    signals, universe, _ = _evaluated(s, d)
    signals = cut_lineage(signals)
    cell = cut_lineage(B.cells(signals, universe, "held_favourable"))
    metrics = {"hit_rate": "held_favourable", "hit_favourable": "held_favourable", "hit_closing": "held_window_closing", "currency_uplift_bps": "currency_gain_bps", "bad_push_rate": "bad_push"}
    named = universe.withColumns({k: F.col(v) for k, v in metrics.items()})
    null = T.pooled_null(T.fold_null(named, cell, _TRIALS, _SEED, list(B.NULLS)), ["iso"], list(B.NULLS))
    observed = cell.groupBy("iso").agg(*[T.weighted_mean(c, "n_signals").alias(c) for c in B.WEIGHTED])
    board = B.null_comparison(observed, cut_lineage(null), ["iso"])
    ci = T.block_bootstrap(signals, ["iso"], "window_advantage_bps", "quote_date", 10, 1000, _SEED).select("iso", F.col("ci_low").alias("window_advantage_ci_low"))
    days = universe.groupBy("iso").agg(F.countDistinct("quote_date").alias("days"))
    rhythm = B.cadence(signals, ["iso"]).join(days, "iso").withColumn("per_week", F.col("n_signals") / (F.col("days") / 5.0))
    return B.evaluate_gates(board.join(ci, "iso").join(rhythm, "iso").withColumnRenamed("iso", "strategy"))


@query("gates_eval", on_p(f"SELECT strategy, gate, {r('value', 'value', 4)}, CAST(ok AS INT) AS passed FROM gv", *_GATED))
def _(s, d):
    return _gated(s, d).select("strategy", "gate", F.round("value", 4).alias("value"), F.col("passed").cast("int").alias("passed"))


@query("pivot_gates", on_p("SELECT strategy, " + ", ".join(f"CAST(max(CAST(ok AS INT)) FILTER (gate = '{g[0]}') AS INT) AS {g[0]}" for g in B.GATES) + " FROM gv GROUP BY strategy", *_GATED))
def _(s, d):
    return B.gate_matrix(_gated(s, d)).select("strategy", *[F.col(g[0]).cast("int").alias(g[0]) for g in B.GATES])


@query("gate_verdicts", on_p("SELECT strategy, count(*) FILTER (ok) AS n_passed, count(*) AS n_gates, coalesce(string_agg(gate, ', ' ORDER BY gate) FILTER (NOT ok), '') AS failed, CASE WHEN bool_and(ok) THEN 'pass' ELSE 'fail' END AS verdict FROM gv GROUP BY strategy", *_GATED))
def _(s, d):
    return B.gate_verdicts(_gated(s, d))


@query("regr_line", on_p(f"SELECT iso, {r('regr_slope(currency_gain_bps, CAST(held_window_closing AS INT))', 'slope', 4)}, {r('regr_intercept(currency_gain_bps, CAST(held_window_closing AS INT))', 'intercept', 4)}, {r('corr(currency_gain_bps, CAST(held_window_closing AS INT))', 'correlation')} FROM un GROUP BY iso", *_EVAL))
def _(s, d):
    x = F.col("held_window_closing").cast("double")
    found = _evaluated(s, d)[1].groupBy("iso").agg(F.regr_slope("currency_gain_bps", x).alias("slope"), F.regr_intercept("currency_gain_bps", x).alias("intercept"), F.corr("currency_gain_bps", x).alias("correlation"))
    return found.select("iso", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("correlation", 6).alias("correlation"))


@query("fold_chart", on_p(f"SELECT fold, {r('avg(currency_uplift_bps)', 'mean_uplift', 4)} FROM ce GROUP BY fold", *_EVAL, _CELL))
def _(s, d):
    signals, universe, _ = _evaluated(s, d)
    return rounded(B.cells(signals, universe, "held_favourable").groupBy("fold").agg(F.avg("currency_uplift_bps").alias("mean_uplift")), "mean_uplift", digits=4, keep=("fold",))


_STATS = ("mean_advantage_bps", "median_advantage_bps", "p10_advantage_bps", "hit_rate", "negative_share", "early_send_rate", "p90_regret_bps")
_GRP = f"""go AS (SELECT iso, (mid - v) / v * 10000 AS a, low < v * (1 - 30.0::DOUBLE / 10000) AS e, greatest(0.0, (v - low) / v * 10000) AS g FROM ow JOIN tk USING (iso, quote_date) WHERE n = 20)"""


@query("grouping_all", on_p(f"""SELECT coalesce(iso, 'ALL') AS iso, count(*) AS n_signals, {r('avg(a)', 'mean_advantage_bps', 4)}, {r('quantile_cont(a, 0.5)', 'median_advantage_bps', 4)}, {r('quantile_cont(a, 0.1)', 'p10_advantage_bps', 4)},
{r('avg(CAST(a > 0 AS INT))', 'hit_rate', 4)}, {r('avg(CAST(a < 0 AS INT))', 'negative_share', 4)}, {r('avg(CAST(e AS INT))', 'early_send_rate', 4)}, {r('quantile_cont(g, 0.9)', 'p90_regret_bps', 4)} FROM go GROUP BY GROUPING SETS ((iso), ())""", _RK, _TOP, _OUT, _GRP))
def _(s, d):
    sent = A.best_per_window(_scores(s, d)).select("iso", "quote_date")
    done = L.build_outcomes(p1(s, d)).filter("outcome_complete").join(sent, ["iso", "quote_date"])
    return rounded(K.with_total(done, [], [F.count(F.lit(1)).alias("n_signals"), *K.outcome_statistics()]), *_STATS, digits=4, keep=("iso", "n_signals"))


@query("matched_random_schedules", on_p(f"""SELECT trial, iso, quote_date FROM (SELECT trial, lg.iso, lg.quote_date, take, row_number() OVER (PARTITION BY trial, lg.iso, lg.w ORDER BY {Q.md5_key(3, 'trial', 'lg.iso', 'lg.quote_date')}) AS place
FROM lg JOIN (SELECT iso, w, count(*) FILTER (sel) AS take FROM lg GROUP BY iso, w) USING (iso, w), (SELECT unnest(range(200)) AS trial) WHERE take > 0) WHERE place <= take""", _RK, _TOP, f"lg AS (SELECT rk.iso, rk.quote_date, {Q.week('rk.quote_date')} AS w, tk.quote_date IS NOT NULL AS sel FROM rk LEFT JOIN tk USING (iso, quote_date) WHERE k IS NOT NULL)"))
def _(s, d):
    scored = _scores(s, d).filter("score is not null").withColumn("window_id", W.window_id("quote_date", "week"))
    best = A.best_per_window(_scores(s, d)).select("iso", "quote_date", F.lit(True).alias("decision"))
    log = scored.join(best, ["iso", "quote_date"], "left").withColumn("decision", F.coalesce("decision", F.lit(False)))
    return T.matched_random_schedules(log.select("iso", "quote_date", "window_id", "decision"), 200, 3).select(F.col("trial").cast("long").alias("trial"), "iso", "quote_date")


@query("backtest_report")
def _(s, d):
    _, found = K.run_backtest(p1(s, d), K.baseline_scores(features(s, d)))
    return found


# The benchmark. Heads need Newton steps, so the tables with SQL hold strategies of both rules and selections without them.

_SPEC = B.BenchmarkSpec()
_NAMED = ("percentile", "reversal", "oracle", "oracle_topk", "percentile_weekly")
_LATE = ", ".join(f"'{n}'" for n in _NAMED if B.STRATEGIES[n].scenario == "window_closing")
_WEEKLY_BEST = lambda name, score, source: f"SELECT '{name}' AS strategy, iso, quote_date FROM (SELECT *, row_number() OVER (PARTITION BY iso, {Q.week('quote_date')} ORDER BY {score} DESC, quote_date) AS n FROM {source} WHERE {score} IS NOT NULL) WHERE n <= 2"
_STACK = f"""rv AS (SELECT *, CASE WHEN v > {Q.lag('v')} THEN -(v - {Q.roll('min', 'v', 90, 20)}) / {Q.roll('min', 'v', 90, 20)} ELSE -1e6 END AS near FROM p),
sc AS (SELECT 'percentile|' || iso AS iso, quote_date, available_on, 1 - k AS score, CAST(NULL AS DOUBLE) AS floor FROM rk WHERE k IS NOT NULL
  UNION ALL SELECT 'reversal|' || iso, quote_date, available_on, near, -1e5 FROM rv WHERE near IS NOT NULL UNION ALL SELECT 'oracle|' || iso, quote_date, available_on, currency_gain_bps, NULL FROM lab WHERE currency_gain_bps IS NOT NULL)"""
_BOARD = f"""em AS (SELECT split_part(iso, '|', 1) AS strategy, split_part(iso, '|', 2) AS iso, quote_date FROM dec WHERE reason = 'selected' UNION ALL {_WEEKLY_BEST('percentile_weekly', '(1 - k)', 'rk')} UNION ALL {_WEEKLY_BEST('oracle_topk', 'currency_gain_bps', 'lab')}),
un AS (SELECT lab.*, fold FROM lab JOIN fd ON quote_date BETWEEN fold_start AND fold_end WHERE ok), sg AS (SELECT strategy, un.*, CAST(CASE WHEN strategy IN ({_LATE}) THEN held_window_closing ELSE held_favourable END AS INT) AS held FROM un JOIN em USING (iso, quote_date)),
ce0 AS (SELECT strategy, iso, fold, count(*) AS n_signals, avg(held) AS hit_rate, avg(CAST(held_favourable AS INT)) AS hit_favourable, avg(CAST(held_window_closing AS INT)) AS hit_closing, avg(currency_gain_bps) AS currency_uplift_bps,
  avg(window_advantage_bps) AS window_advantage_bps, avg(regret_bps) AS regret_bps, avg(CAST(bad_push AS INT)) AS bad_push_rate FROM sg GROUP BY ALL),
bs AS (SELECT iso, fold, currency_gain_bps AS g, row_number() OVER (PARTITION BY iso, fold ORDER BY currency_gain_bps DESC, quote_date) AS place FROM un WHERE currency_gain_bps IS NOT NULL),
cl AS (SELECT strategy, iso, fold, avg(g) AS ceiling_bps FROM ce0 JOIN bs USING (iso, fold) WHERE place <= n_signals GROUP BY ALL),
gr AS (SELECT iso, fold, any_value(fold_start) AS fold_start, any_value(fold_end) AS fold_end, count(*) AS trading_days FROM un JOIN fd USING (fold) GROUP BY ALL),
ce AS (SELECT * REPLACE (coalesce(n_signals, 0) AS n_signals), coalesce(n_signals, 0) / (trading_days / 5.0) AS per_week FROM gr CROSS JOIN (SELECT unnest([{', '.join(f"'{n}'" for n in _NAMED)}]) AS strategy) LEFT JOIN ce0 USING (strategy, iso, fold) LEFT JOIN cl USING (strategy, iso, fold))"""
_CELLED = ("ceiling_bps", "hit_rate", "hit_favourable", "hit_closing", "currency_uplift_bps", "window_advantage_bps", "regret_bps", "bad_push_rate")
_WMEAN = lambda c, w="n_signals": f"sum({c} * {w}) FILTER ({c} IS NOT NULL AND {w} > 0) / sum({w}) FILTER ({c} IS NOT NULL AND {w} > 0)"
# every strategy of a fold reads its own budget off one order of the days per trial
_DRAWN = f"""dr AS (SELECT un.iso, un.fold, trial, held_favourable, held_window_closing, currency_gain_bps, window_advantage_bps, bad_push, row_number() OVER (PARTITION BY un.iso, un.fold, trial ORDER BY {Q.md5_key(_SPEC.seed, 'trial', 'un.iso', 'un.quote_date')}) AS place FROM un, (SELECT unnest(range({_SPEC.random_trials})) AS trial)),
nu AS (SELECT strategy, iso, fold, trial, n_signals, avg(CAST(CASE WHEN strategy IN ({_LATE}) THEN held_window_closing ELSE held_favourable END AS INT)) AS hit_rate, avg(currency_gain_bps) AS currency_uplift_bps, avg(window_advantage_bps) AS window_advantage_bps, avg(CAST(bad_push AS INT)) AS bad_push_rate FROM dr JOIN (SELECT strategy, iso, fold, n_signals FROM ce0) USING (iso, fold) WHERE place <= n_signals GROUP BY ALL)"""


def _compared(keys: str, source: str, name: str) -> str:
    """CTEs to ``name``: lifts, deltas and p-values of ``source`` (with hit_rate, currency_uplift_bps, bad_push_rate) per ``keys``."""
    return f"""{name}_t AS (SELECT {keys}, trial, {_WMEAN('hit_rate')} AS nh, {_WMEAN('currency_uplift_bps')} AS nc, {_WMEAN('bad_push_rate')} AS nb FROM nu GROUP BY {keys}, trial),
{name} AS (SELECT {keys}, any_value(hit_rate) / avg(nh) AS hit_lift, any_value(currency_uplift_bps) - avg(nc) AS currency_uplift_delta_bps, any_value(bad_push_rate) - avg(nb) AS bad_push_delta, any_value(currency_uplift_bps) - quantile_cont(nc, 0.975) AS uplift_over_null_q975_bps,
  (count(*) FILTER (round(nc, 9) >= round(currency_uplift_bps, 9)) + 1) / (count(nc) + 1)::DOUBLE AS p_value, (count(*) FILTER (round(nh, 9) >= round(hit_rate, 9)) + 1) / (count(nh) + 1)::DOUBLE AS p_value_hit FROM {name}_t JOIN {source} USING ({keys}) GROUP BY {keys})"""


def _tested(keys: str, order: str, name: str) -> str:
    """CTEs to ``name``: bootstrap bounds and Newey-West errors of both columns of ``sg`` per ``keys``."""
    tall = " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, {c} AS x, {order} AS o FROM sg WHERE {c} IS NOT NULL" for m, c in B.SIGNIFICANT.items())
    on, key = [*keys.split(", "), "metric"], Q.md5_key(_SPEC.seed, *keys.split(", "), "trial", "blk")
    wide = ", ".join(f"any_value({c}) FILTER (metric = '{m}') AS {m}_{n}" for m in B.SIGNIFICANT for n, c in (("ci_low", "ci_low"), ("ci_high", "ci_high"), ("hac_se", "se"), ("hac_t", "mean / se")))
    return f"""{name}_v AS (SELECT {keys}, metric, x, row_number() OVER w AS at, count(*) OVER (PARTITION BY {keys}, metric) AS n, x - avg(x) OVER (PARTITION BY {keys}, metric) AS d, sum(x) OVER w AS upto FROM ({tall}) WINDOW w AS (PARTITION BY {keys}, metric ORDER BY o ROWS UNBOUNDED PRECEDING)),
{name}_p AS (SELECT *, CAST('0x' || substr({key}, 1, 12) AS BIGINT) % (n - w + 1) AS b, least(w, n - blk * w) AS len FROM (SELECT {keys}, metric, n, least({_SPEC.horizon}, n) AS w, trial, unnest(range(CAST(ceil(n / least({_SPEC.horizon}, n)::DOUBLE) AS BIGINT))) AS blk FROM (SELECT DISTINCT {keys}, metric, n FROM {name}_v), (SELECT unnest(range({_SPEC.bootstrap_trials})) AS trial))),
{name}_b AS (SELECT {keys}, metric, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (SELECT {', '.join(f'q.{k}' for k in on)}, sum(e.upto - coalesce(s.upto, 0)) / any_value(q.n) AS m
  FROM {name}_p q JOIN {name}_v e ON {' AND '.join(f'e.{k} = q.{k}' for k in on)} AND e.at = q.b + q.len LEFT JOIN {name}_v s ON {' AND '.join(f's.{k} = q.{k}' for k in on)} AND s.at = q.b GROUP BY {', '.join(f'q.{k}' for k in on)}, q.trial) GROUP BY ALL),
{name}_l AS (SELECT a.*, b.d AS e, l FROM {name}_v a, unnest(range(CAST(floor(4 * pow(a.n / 100.0, 2.0 / 9)) AS BIGINT) + 1)) AS t(l), {name}_v b WHERE {' AND '.join(f'a.{k} = b.{k}' for k in on)} AND b.at = a.at - l),
{name}_s AS (SELECT {keys}, metric, n, sum(CASE WHEN l = 0 THEN d * e ELSE 2 * (1 - l / (floor(4 * pow(n / 100.0, 2.0 / 9)) + 1)) * d * e END) / n AS var FROM {name}_l GROUP BY {keys}, metric, n),
{name} AS (SELECT {keys}, {wide} FROM (SELECT {keys}, metric, ci_low, ci_high, mean, sqrt(var / n) AS se FROM {name}_b JOIN {name}_s USING ({keys}, metric) JOIN (SELECT {keys}, metric, avg(x) AS mean FROM {name}_v GROUP BY {keys}, metric) USING ({keys}, metric)) GROUP BY {keys})"""


_CORRIDOR = f"""gp AS (SELECT *, date_diff('day', lag(quote_date) OVER (PARTITION BY strategy, iso ORDER BY quote_date), quote_date) AS gap FROM sg),
rh AS (SELECT strategy, iso, stddev_samp(gap) / avg(gap) AS interval_cv, max(gap) AS max_gap_days, avg(CAST(gap <= 5 AS INT)) AS series_share FROM gp GROUP BY ALL),
ro AS (SELECT strategy, iso, CAST(sum(n_signals) AS BIGINT) AS n_signals, {', '.join(f'{_WMEAN(c)} AS {c}' for c in _CELLED)}, sum(n_signals) / (sum(trading_days) / 5.0) AS per_week FROM ce GROUP BY ALL),
{_compared('strategy, iso', 'ro', 'nc1')}, {_tested('strategy, iso', "CAST(quote_date AS VARCHAR)", 'st1')},
qv AS (SELECT *, least(1.0, min(p_value * m / rk2) OVER (PARTITION BY strategy ORDER BY rk2 DESC ROWS UNBOUNDED PRECEDING)) AS q_value FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY p_value, iso) AS rk2, count(*) OVER (PARTITION BY strategy) AS m FROM nc1)),
co AS (SELECT * FROM ro LEFT JOIN rh USING (strategy, iso) LEFT JOIN qv USING (strategy, iso) LEFT JOIN st1 USING (strategy, iso))"""
_ROLLED = f"""bo AS (SELECT strategy, CAST(sum(n_signals) AS BIGINT) AS n_signals, count(*) AS n_corridors, {', '.join(f'{_WMEAN(c)} AS {c}' for c in (*_CELLED, 'interval_cv', 'series_share'))}, min(currency_uplift_bps) AS currency_uplift_bps_worst_corridor,
avg(per_week) AS per_week, max(max_gap_days) AS max_gap_days, count(*) FILTER (currency_uplift_bps > 0) AS corridors_positive, count(*) FILTER (q_value <= 0.05) AS corridors_significant FROM co GROUP BY strategy),
{_compared('strategy', 'bo', 'nc2')}, {_tested('strategy', "iso || '|' || CAST(quote_date AS VARCHAR)", 'st2')}"""
_BENCHED = (_RK, _LAB, _FOLD, _STACK, _policy("floor"), _DEC, _BOARD)
_TESTED = [f"{m}_{n}" for m in B.SIGNIFICANT for n in ("ci_low", "ci_high", "hac_se", "hac_t")]
_COMPARED = ("hit_lift", "currency_uplift_delta_bps", "bad_push_delta", "uplift_over_null_q975_bps", "p_value", "p_value_hit")
_CORRIDORS = [*_CELLED, "per_week", "interval_cv", "series_share", *_COMPARED, "q_value", *_TESTED]
_BOARDED = [*_CELLED, "currency_uplift_bps_worst_corridor", "per_week", "interval_cv", "series_share", *_COMPARED, *_TESTED, "cbsb_score"]


def _bench_sql(body: str, *more: str) -> str:
    return f"WITH RECURSIVE {Q.P}, {', '.join((*_BENCHED, *more))} {body}"


def _benched(s, d):
    return B.run_benchmark(cut_lineage(p1(s, d)), names=list(_NAMED), usd=usd(s, d))


@query("board_cells", _bench_sql("SELECT strategy, iso, fold, fold_start, fold_end, n_signals, trading_days, " + ", ".join(r(c, c, 4) for c in (*_CELLED, "per_week")) + " FROM ce"))
def _(s, d):
    return rounded(B.evaluated(p1(s, d), _SPEC, list(_NAMED), usd(s, d))[2], *_CELLED, "per_week", digits=4, keep=("strategy", "iso", "fold", "fold_start", "fold_end", "n_signals", "trading_days"))


@query("board_corridors", _bench_sql("SELECT strategy, iso, n_signals, CAST(max_gap_days AS BIGINT) AS max_gap_days, " + ", ".join(r(c, c, 4) for c in _CORRIDORS) + " FROM co", _DRAWN, _CORRIDOR))
def _(s, d):
    found = _benched(s, d).corridors.withColumn("max_gap_days", F.col("max_gap_days").cast("long"))
    return rounded(found, *_CORRIDORS, digits=4, keep=("strategy", "iso", "n_signals", "max_gap_days"))


@query("board", _bench_sql("SELECT strategy, n_signals, n_corridors, corridors_positive, corridors_significant, CAST(max_gap_days AS BIGINT) AS max_gap_days, " + ", ".join(r("CASE WHEN ceiling_bps > 0 THEN currency_uplift_bps / ceiling_bps * 100 END" if c == "cbsb_score" else c, c, 4) for c in _BOARDED) + " FROM bo LEFT JOIN nc2 USING (strategy) LEFT JOIN st2 USING (strategy)", _DRAWN, _CORRIDOR, _ROLLED))
def _(s, d):
    found = _benched(s, d).leaderboard.withColumn("max_gap_days", F.col("max_gap_days").cast("long"))
    return rounded(found, *_BOARDED, digits=4, keep=("strategy", "n_signals", "n_corridors", "corridors_positive", "corridors_significant", "max_gap_days"))


_HELD_AT = " UNION ALL ".join(f"SELECT strategy, {h} AS h, CAST(CASE WHEN strategy IN ({_LATE}) THEN l{h}.held_window_closing ELSE l{h}.held_favourable END AS INT) AS hit FROM sg JOIN l{h} USING (iso, quote_date) WHERE l{h}.ok" for h in _HS)


@query("board_horizons", _bench_sql("SELECT strategy, " + ", ".join(r(f"avg(hit) FILTER (h = {h})", f"hit_h{h}") for h in _HS) + f" FROM ({_HELD_AT}) GROUP BY strategy", *[Q.labels(h, 1, name=f"l{h}") for h in _HS]))
def _(s, d):
    panel = cut_lineage(p1(s, d))
    return rounded(B.horizon_table(panel, B.evaluated(panel, _SPEC, list(_NAMED), usd(s, d))[0], _HS), *[f"hit_h{h}" for h in _HS], keep=("strategy",))


@query("leaderboard")
def _(s, d):
    return B.run_benchmark(cut_lineage(p1(s, d)), names=list(B.STRATEGIES), usd=usd(s, d)).leaderboard


def _cadence_sql() -> str:
    """Each budget as a policy of its own over the stacked scores of percentile and oracle."""
    parts, found = [], []
    for i, (label, window, most, cooldown) in enumerate(B.CADENCES):
        config = A.PolicyConfig(window, most, cooldown)
        levels, e = "[" + ", ".join(f"{q!r}" for q in config.levels()) + "]", config.expected
        day = Q.week("available_on") if window == "week" else "strftime(available_on, '%Y-%m')"
        limits = ", ".join(f"CASE WHEN hist >= 20 THEN q[{k * e} + rest] END" for k in range(most + 1))
        parts.append(f"""pw{i} AS (SELECT *, {day} AS window_id, row_number() OVER ({Q.O}) - 1 AS pos FROM sc2), ps{i} AS (SELECT *, row_number() OVER (PARTITION BY iso, window_id ORDER BY quote_date) AS seen, count(score) {Q.over(-250, -1)} AS hist, quantile_cont(score, {levels}) {Q.over(-250, -1)} AS q FROM pw{i}),
th{i} AS (SELECT *, [{limits}] AS t FROM (SELECT *, greatest(1, {e} - seen + 1) AS rest FROM ps{i})),
de{i} AS (SELECT iso, CAST(-1 AS BIGINT) AS pos, CAST('' AS VARCHAR) AS win, 0 AS used, CAST(NULL AS BIGINT) AS last, false AS sent, CAST(NULL AS DATE) AS quote_date FROM (SELECT DISTINCT iso FROM th{i}) UNION ALL
  SELECT iso, pos, win, CASE WHEN sent THEN used + 1 ELSE used END, CASE WHEN sent THEN pos ELSE last END, sent, quote_date FROM (SELECT iso, pos, win, used, last, quote_date, hist >= 20 AND used < {most} AND (last IS NULL OR {cooldown} - (pos - last) + 1 <= 0) AND score >= t[{most} - used + 1] AS sent
    FROM (SELECT th.iso, th.pos, th.window_id AS win, CASE WHEN th.window_id = d.win THEN d.used ELSE 0 END AS used, d.last, th.quote_date, th.hist, th.score, th.t FROM de{i} d JOIN th{i} th ON th.iso = d.iso AND th.pos = d.pos + 1)))""")
        found.append(f"SELECT '{label}' AS cadence, '{window}' AS \"window\", {most} AS max_per_window, {cooldown} AS cooldown, iso, quote_date FROM de{i} WHERE sent")
    return ", ".join(parts) + f", cs AS (SELECT c.* EXCLUDE (iso), split_part(c.iso, '|', 1) AS strategy, ud.* FROM ({' UNION ALL '.join(found)}) c JOIN (SELECT * FROM lab WHERE ok AND quote_date >= DATE '1997-01-01') ud ON ud.iso = split_part(c.iso, '|', 2) AND ud.quote_date = c.quote_date)"


_SWEPT = ("per_week", "currency_uplift_bps", "hit_closing", "bad_push_rate", "interval_cv", "series_share")


def _swept(s, d, names):
    panel = p1(s, d)
    strategies = B.swept_strategies(names)
    found = B.cadence_sweep(B.build_scores(panel, strategies, features(s, d)), strategies, B.evaluated_days(panel, _SPEC))
    return rounded(found.withColumn("max_gap_days", F.col("max_gap_days").cast("long")), *_SWEPT, digits=4, keep=("cadence", "window", "max_per_window", "cooldown", "strategy", "n_signals", "max_gap_days"))


@query("cadence_sweep_rules", f"""WITH RECURSIVE {Q.P}, {_RK}, {_LAB}, sc2 AS (SELECT 'percentile|' || iso AS iso, quote_date, available_on, 1 - k AS score FROM rk WHERE k IS NOT NULL UNION ALL SELECT 'oracle|' || iso, quote_date, available_on, currency_gain_bps FROM lab WHERE currency_gain_bps IS NOT NULL),
{_cadence_sql()}, cz AS (SELECT count(DISTINCT iso) AS series, count(*) AS days FROM lab WHERE ok AND quote_date >= DATE '1997-01-01'),
cg AS (SELECT *, date_diff('day', lag(quote_date) OVER (PARTITION BY cadence, strategy, iso ORDER BY quote_date), quote_date) AS gap FROM cs), ci AS (SELECT cadence, strategy, iso, count(*) AS n, stddev_samp(gap) / avg(gap) AS cv, max(gap) AS mg, avg(CAST(gap <= 5 AS INT)) AS ss FROM cg GROUP BY ALL HAVING stddev_samp(gap) IS NOT NULL)
SELECT cadence, "window", max_per_window, cooldown, strategy, n AS n_signals, mg AS max_gap_days, {r('n / series / (days / series / 5.0)', 'per_week', 4)}, {r('up', 'currency_uplift_bps', 4)}, {r('hc', 'hit_closing', 4)}, {r('bp', 'bad_push_rate', 4)}, {r('cv', 'interval_cv', 4)}, {r('ss', 'series_share', 4)}
FROM (SELECT cadence, "window", max_per_window, cooldown, strategy, count(*) AS n, avg(currency_gain_bps) AS up, avg(CAST(held_window_closing AS INT)) AS hc, avg(CAST(bad_push AS INT)) AS bp FROM cs GROUP BY ALL)
LEFT JOIN (SELECT cadence, strategy, sum(cv * n) / sum(n) AS cv, sum(ss * n) / sum(n) AS ss, max(mg) AS mg FROM ci GROUP BY ALL) USING (cadence, strategy), cz""")
def _(s, d):
    return _swept(s, d, ["oracle", "percentile"])


@query("cadence_sweep")
def _(s, d):
    return _swept(s, d, list(B.STRATEGIES))


# Indicators, as-of joins and simulation

_POS = f"po AS (SELECT *, {Q.roll('min', 'v', 60, 15)} AS lo, {Q.roll('max', 'v', 60, 15)} AS hi, v > {Q.lag('v')} AS up FROM p)"
_VAL = f"SELECT iso, quote_date AS signal_date, {r('v', V)} FROM "


def _ev(df):
    return df.select("iso", "signal_date", F.round(V, 6).alias(V))


@query("value_signals", on_p(_VAL + "po WHERE (v - lo) / nullif(hi - lo, 0) < 0.2", _POS))
def _(s, d):
    return _ev(I.value(p1(s, d)))


@query("momentum_signals", on_p(_VAL + "streak WHERE down_streak >= 3", Q.STREAK))
def _(s, d):
    return _ev(I.momentum(p1(s, d)))


@query("value_reversal_signals", on_p(_VAL + "po WHERE (v - lo) / nullif(hi - lo, 0) < 0.2 AND up", _POS))
def _(s, d):
    return _ev(I.value_reversal(p1(s, d)))


@query("reversal_min_signals", on_p(_VAL + "po WHERE (v - lo) / lo < 0.02 AND up", _POS))
def _(s, d):
    return _ev(I.reversal_from_min(p1(s, d), pct=0.02))


_PAIR = "fa AS (SELECT iso, quote_date FROM po WHERE (v - lo) / nullif(hi - lo, 0) < 0.2), sl AS (SELECT iso, quote_date FROM po WHERE (v - lo) / nullif(hi - lo, 0) < 0.2 AND up)"


@query("waiting_cost_asof", on_p(f"""SELECT iso, count(*) AS n_pairs, {r('quantile_cont((b.v / a.v - 1) * 10000, 0.5)', 'median_bps', 4)} FROM (SELECT fa.iso, fa.quote_date AS f, min(sl.quote_date) AS t FROM fa JOIN sl ON sl.iso = fa.iso AND sl.quote_date > fa.quote_date GROUP BY 1, 2) m
JOIN p a USING (iso) JOIN p b USING (iso) WHERE a.quote_date = f AND b.quote_date = t GROUP BY iso""", _POS, _PAIR))
def _(s, d):
    return rounded(I.waiting_cost(p1(s, d), I.value(p1(s, d)), I.value_reversal(p1(s, d))), "median_bps", digits=4, keep=("iso", "n_pairs"))


@query("next_quote_asof", on_p("SELECT e.iso, e.quote_date AS signal_date, min(q.quote_date) AS mark_date FROM (SELECT iso, CAST(quote_date + 1 AS DATE) AS quote_date FROM po WHERE (v - lo) / nullif(hi - lo, 0) < 0.2) e LEFT JOIN p q ON q.iso = e.iso AND q.quote_date >= e.quote_date GROUP BY 1, 2", _POS))
def _(s, d):
    events = I.value(p1(s, d)).withColumn("signal_date", F.date_add("signal_date", 1))
    return I.next_on_or_after(events, p1(s, d).select("iso", F.col("quote_date").alias("mark_date")), strict=False)


_HELD = f"he AS (SELECT *, coalesce(max(v) {Q.over(1, 5)} <= v + 1e-12, false) AS hit, row_number() OVER ({Q.O}) AS pos, count(*) OVER (PARTITION BY iso) AS n FROM p)"


@query("lift_over_random", on_p(f"""SELECT coalesce(iso, 'ALL') AS iso, CAST(sum(n) AS BIGINT) AS n_signals, {r('sum(h) / sum(n)', 'hit_rate')}, {r('sum(b * n) / sum(n)', 'random_hit')}, {r('(sum(h) / sum(n)) / (sum(b * n) / sum(n))', 'lift')}
FROM (SELECT iso, count(*) AS n, CAST(sum(CAST(hit AS INT)) AS DOUBLE) AS h FROM he JOIN fa USING (iso, quote_date) GROUP BY iso) JOIN (SELECT iso, avg(CAST(hit AS INT)) AS b FROM he WHERE pos <= n - 5 GROUP BY iso) USING (iso) GROUP BY ROLLUP (iso)""", _POS, _PAIR, _HELD))
def _(s, d):
    return rounded(I.hit_rates(p1(s, d), I.value(p1(s, d)), 5, "favourable_now"), "hit_rate", "random_hit", "lift", keep=("iso", "n_signals"))


def _lift(h: int) -> str:
    """A SELECT of n_signals, hit_rate, random_hit and lift per series and of all at horizon ``h``."""
    held = f"SELECT *, coalesce(max(v) {Q.over(1, h)} <= v + 1e-12, false) AS hit, row_number() OVER ({Q.O}) AS pos, count(*) OVER (PARTITION BY iso) AS n FROM p"
    return f"""SELECT coalesce(iso, 'ALL') AS iso, {h} AS horizon, CAST(sum(n) AS BIGINT) AS n_signals, {r('sum(h) / sum(n)', 'hit_rate')}, {r('sum(b * n) / sum(n)', 'random_hit')}, {r('(sum(h) / sum(n)) / (sum(b * n) / sum(n))', 'lift')}
FROM (SELECT iso, count(*) AS n, CAST(sum(CAST(hit AS INT)) AS DOUBLE) AS h FROM ({held}) JOIN fa USING (iso, quote_date) GROUP BY iso) JOIN (SELECT iso, avg(CAST(hit AS INT)) AS b FROM ({held}) WHERE pos <= n - {h} GROUP BY iso) USING (iso) GROUP BY ROLLUP (iso)"""


def _metrics(h: int) -> str:
    """A SELECT of ``_lift`` with the advantage over the window of ``h`` days either side and its t."""
    days = f"SELECT iso, quote_date, CASE WHEN count(v) {Q.over(-h, h)} >= 2 THEN (avg(v) {Q.over(-h, h)} - v) / v * 10000 END AS a FROM p"
    return f"SELECT * FROM ({_lift(h)}) LEFT JOIN (SELECT coalesce(iso, 'ALL') AS iso, {r('avg(a)', 'advantage_bps')}, {r('avg(a) / (stddev_samp(a) / sqrt(count(a)))', 'advantage_tstat')} FROM ({days}) JOIN fa USING (iso, quote_date) GROUP BY ROLLUP (iso)) USING (iso)"


_METRICS = ("hit_rate", "random_hit", "lift", "advantage_bps", "advantage_tstat")


@query("metric_matrix", on_p(f"{_metrics(5)} UNION ALL {_metrics(15)}", _POS, _PAIR))
def _(s, d):
    return rounded(I.metric_matrix(p1(s, d), I.value(p1(s, d))), *_METRICS, keep=("iso", "horizon", "n_signals"))


@query("metric_summary", on_p(f"SELECT iso, {r('avg(hit_rate)', 'hit_rate', 3)}, {r('avg(lift)', 'lift', 3)}, {r('avg(advantage_bps)', 'advantage_bps', 3)} FROM ({_metrics(5)} UNION ALL {_metrics(15)}) GROUP BY iso", _POS, _PAIR))
def _(s, d):
    return E.metric_summary(rounded(I.metric_matrix(p1(s, d), I.value(p1(s, d))), *_METRICS, keep=("iso", "horizon", "n_signals")))


@query("window_advantage", on_p(f"SELECT {r('avg(a)', 'advantage_bps', 4)}, {r('stddev_samp(a) / sqrt(count(a))', 'stderr', 4)}, count(a) AS n, {r('avg(a) / (stddev_samp(a) / sqrt(count(a)))', 't_stat', 4)} FROM (SELECT iso, quote_date, CASE WHEN count(v) {Q.over(-5, 5)} >= 2 THEN (avg(v) {Q.over(-5, 5)} - v) / v * 10000 END AS a FROM p) JOIN fa USING (iso, quote_date)", _POS, _PAIR))
def _(s, d):
    return rounded(I.window_advantage(p1(s, d), I.value(p1(s, d)), 5), "advantage_bps", "stderr", "t_stat", digits=4, keep=("n",))


@query("future_paths", on_p(f"SELECT iso, quote_date AS signal_date, len(f) AS n_future, {r('list_min(f)', 'low')}, {r('list_max(f)', 'high')} FROM (SELECT *, coalesce(list(v) {Q.over(1, 5)}, []) AS f FROM p)"))
def _(s, d):
    f = F.col("future")
    return I.future_paths(p1(s, d), 5).select("iso", "signal_date", F.size(f).cast("long").alias("n_future"), F.round(F.array_min(f), 6).alias("low"), F.round(F.array_max(f), 6).alias("high"))


_SIM = f"""bu AS (SELECT iso, 50000.0::DOUBLE * greatest(1.0, date_diff('day', min(quote_date), max(quote_date)) / 30.44::DOUBLE) AS total, count(*) AS days FROM p GROUP BY iso),
fn AS (SELECT iso, count(*) AS n FROM fa GROUP BY iso), mo AS (SELECT iso, sum(total / n / v) AS currency, avg(v) AS avg_rate, count(*) AS n_buys FROM fa JOIN p USING (iso, quote_date) JOIN fn USING (iso) JOIN bu USING (iso) GROUP BY iso),
rg AS (SELECT * FROM (SELECT *, row_number() OVER ({Q.O}) - 1 AS pos FROM p) WHERE pos % 5 = 0), rn AS (SELECT iso, count(*) AS n FROM rg GROUP BY iso), dc AS (SELECT iso, sum(total / n / v) AS currency, avg(v) AS avg_rate, count(*) AS n_buys FROM rg JOIN rn USING (iso) JOIN bu USING (iso) GROUP BY iso),
rw AS (SELECT iso, trial, sum(total / n / v) AS currency, avg(v) AS avg_rate, count(*) AS n_buys FROM (SELECT p.iso, v, total, fn.n, trial, row_number() OVER (PARTITION BY p.iso, trial ORDER BY {Q.md5_key(0, 'trial', 'p.iso', 'p.quote_date')}) AS place FROM p JOIN fn USING (iso) JOIN bu USING (iso), (SELECT unnest(range(500)) AS trial) WHERE days > fn.n) WHERE place <= n GROUP BY iso, trial),
si AS (SELECT 'model' AS strategy, * FROM mo UNION ALL SELECT 'dca', * FROM dc UNION ALL SELECT 'random', iso, avg(currency), avg(avg_rate), max(n_buys) FROM rw GROUP BY iso)"""


@query("budget_simulation", on_p(f"SELECT strategy, iso, {r('currency', 'currency', 4)}, {r('avg_rate', 'avg_rate', 4)}, n_buys FROM si", _POS, _PAIR, _SIM))
def _(s, d):
    return rounded(U.simulate(p1(s, d), I.value(p1(s, d))), "currency", "avg_rate", digits=4, keep=("strategy", "iso", "n_buys"))


@query("uplift_pct", on_p(f"SELECT iso, {r('(max(currency) FILTER (strategy = $$model$$) / max(currency) FILTER (strategy = $$dca$$) - 1) * 100', 'uplift_vs_dca')}, {r('(max(currency) FILTER (strategy = $$model$$) / max(currency) FILTER (strategy = $$random$$) - 1) * 100', 'uplift_vs_random')} FROM si GROUP BY iso", _POS, _PAIR, _SIM))
def _(s, d):
    return rounded(U.uplift(U.simulate(p1(s, d), I.value(p1(s, d)))), "uplift_vs_dca", "uplift_vs_random", keep=("iso",))


_VERDICT = """SELECT *, CASE WHEN lift < 1.0 OR dca <= 0 THEN 'drop' WHEN lift >= 1.3 AND dca > 0 AND NOT coalesce(pw < 1.0 OR pw > 2.0, false) THEN 'keep' ELSE 'marginal' END AS verdict,
CASE WHEN lift < 1.0 OR dca <= 0 THEN concat_ws('; ', CASE WHEN lift < 1.0 THEN printf('lift %.2f, no better than random days', lift) END, CASE WHEN dca <= 0 THEN printf('%+.2f%% against a regular pace', dca) END)
WHEN lift >= 1.3 AND dca > 0 AND coalesce(pw < 1.0 OR pw > 2.0, false) THEN printf('%.1f a week, outside 1.0 to 2.0', pw) WHEN lift >= 1.3 AND dca > 0 THEN printf('lift %.2f, %+.2f%% against a regular pace, %.1f a week', lift, dca, pw)
ELSE coalesce(printf('lift %.2f, %+.2f%% against a regular pace', lift, dca), 'too few signals to judge') END AS reason FROM"""


@query("verdicts", on_p(f"""SELECT iso, verdict, reason FROM ({_VERDICT} (SELECT iso, lift FROM ({_lift(5)})) JOIN (SELECT iso, (max(currency) FILTER (strategy = $$model$$) / max(currency) FILTER (strategy = $$dca$$) - 1) * 100 AS dca FROM si GROUP BY iso) USING (iso)
JOIN (SELECT iso, n / (days / 5.0) AS pw FROM fn JOIN bu USING (iso)) USING (iso))""", _POS, _PAIR, _SIM))
def _(s, d):
    panel = p1(s, d)
    events = I.value(panel)
    lift = I.hit_rates(panel, events, 5, "favourable_now").select("iso", F.col("lift").alias("lift_h5"))
    week = B.frequency(events, panel).select("iso", "per_week")
    return I.verdicts(lift.join(U.uplift(U.simulate(panel, events)), "iso").join(week, "iso")).select("iso", "verdict", "reason")


def _grid_sql() -> str:
    """CTEs to gu (uplift per parameters and fold): all grids over the last four half years."""
    windows = sorted({w for g in I.GRIDS.values() for w in g.get("window", ())})
    pos = f"gp0 AS (SELECT *, v > {Q.lag('v')} AS up, " + ", ".join(f"{Q.roll('min', 'v', w, max(5, w // 4))} AS lo{w}, {Q.roll('max', 'v', w, max(5, w // 4))} AS hi{w}" for w in windows) + " FROM streak)"
    mask = {
        "value": "(v - lo{window}) / nullif(hi{window} - lo{window}, 0) < {lo_pct}", "momentum": "down_streak >= {n}",
        "value_reversal": "(v - lo{window}) / nullif(hi{window} - lo{window}, 0) < {lo_pct} AND up", "reversal_from_min": "(v - lo{window}) / lo{window} < {pct} AND up",
    }
    sets = [(name, turn, given) for name, grid in I.GRIDS.items() for turn, given in enumerate(I.parameter_sets(grid))]
    events = " UNION ALL ".join(f"SELECT '{name}' AS indicator, {turn} AS turn, iso, quote_date, v FROM gp0 WHERE {mask[name].format(**given)}" for name, turn, given in sets)
    values = ", ".join(f"('{name}', {turn}, '{','.join(f'{k}={v}' for k, v in sorted(given.items()))}')" for name, turn, given in sets)
    return f"""{Q.STREAK}, {pos}, ge AS ({events}), gt AS (SELECT * FROM (VALUES {values}) AS t(indicator, turn, params)),
    gf AS (SELECT iso, i AS fold, CAST(last - to_months(CAST(6 * (i + 1) AS INT)) AS DATE) AS fs FROM (SELECT iso, max(quote_date) AS last, min(quote_date) AS first FROM p GROUP BY iso), (SELECT unnest(range(4)) AS i) WHERE first < CAST(last - to_months(CAST(6 * (i + 1) AS INT)) AS DATE)),
    gw AS (SELECT p.*, fold, row_number() OVER (PARTITION BY p.iso, fold ORDER BY quote_date) - 1 AS pos FROM p JOIN gf ON gf.iso = p.iso AND quote_date >= fs),
    gb AS (SELECT iso, fold, 50000.0::DOUBLE * greatest(1.0, date_diff('day', min(quote_date), max(quote_date)) / 30.44::DOUBLE) AS total FROM gw GROUP BY iso, fold),
    gc AS (SELECT iso, fold, total / count(*) * sum(1 / v) AS paced, any_value(total) AS total FROM gw JOIN gb USING (iso, fold) WHERE pos % 5 = 0 GROUP BY iso, fold, total),
    gn AS (SELECT indicator, turn, ge.iso, fold, count(*) AS n, sum(1 / v) AS per FROM ge JOIN gf ON gf.iso = ge.iso AND quote_date >= fs GROUP BY ALL),
    gu AS (SELECT indicator, turn, params, gc.iso, fold, round((coalesce(total / n * per, 0) - paced) / paced * 100, 9) AS uplift FROM gc CROSS JOIN gt LEFT JOIN gn USING (indicator, turn, iso, fold))"""


@query("fold_uplifts", on_p(f"SELECT indicator, iso, params, fold, {r('uplift', 'uplift', 4)} FROM gu", _grid_sql()))
def _(s, d):
    return E.fold_uplifts(p1(s, d)).select("indicator", "iso", "params", F.col("fold").cast("long").alias("fold"), F.round("uplift", 4).alias("uplift"))


@query("calibrate", on_p(f"""SELECT indicator, iso, params, {r('mid', 'median_uplift', 4)}, n_folds FROM (SELECT *, row_number() OVER (PARTITION BY indicator, iso ORDER BY mid DESC, turn) AS place FROM
(SELECT indicator, iso, params, turn, quantile_cont(uplift, 0.5) AS mid, count(*) AS n_folds FROM gu GROUP BY ALL HAVING count(*) >= 2)) WHERE place = 1""", _grid_sql()))
def _(s, d):
    return E.calibrate_indicators(p1(s, d)).select("indicator", "iso", "params", F.round("median_uplift", 4).alias("median_uplift"), "n_folds")


def _matrix_sql() -> str:
    """CTEs to ix: four indicators with calibrated parameters over the trailing year; random days drawn per indicator and series."""
    names = ", ".join(f"('{n}', '{I.SPEED[n]}', {E.own_scenario(n) == 'window_closing'})" for n in I.GRIDS)
    held = ", ".join(f"coalesce(max(v) {Q.over(1, h)} <= v + 1e-12, false) AS f{h}, coalesce(quantile_cont(v, 0.5) {Q.over(1, h)} > v + 1e-12, false) AS c{h}" for h in (5, 15))
    flags = [f"{k}{h}" for h in (5, 15) for k in "fc"]
    own = lambda c, yes, no: f"CASE WHEN closing THEN {c.format(yes)} ELSE {c.format(no)} END"
    lift = "hit_{0} / nullif(base_{0}, 0)"
    return f"""ip AS (SELECT indicator, iso, params FROM (SELECT *, row_number() OVER (PARTITION BY indicator, iso ORDER BY mid DESC, turn) AS place FROM (SELECT indicator, iso, params, turn, quantile_cont(uplift, 0.5) AS mid FROM gu GROUP BY ALL HAVING count(*) >= 2)) WHERE place = 1),
ib AS (SELECT CAST(max(quote_date) - to_months(12) AS DATE) AS s, max(quote_date) AS e FROM p), iy AS (SELECT p.* FROM p, ib WHERE quote_date BETWEEN s AND e),
it AS (SELECT * FROM (VALUES {names}) AS t(indicator, speed, closing)), iall AS (SELECT indicator, iso, quote_date, v FROM ge JOIN gt USING (indicator, turn) JOIN ip USING (indicator, iso, params)), ie AS (SELECT iall.* FROM iall, ib WHERE quote_date BETWEEN s AND e),
iu AS (SELECT iso, 50000.0::DOUBLE * greatest(1.0, date_diff('day', min(quote_date), max(quote_date)) / 30.44::DOUBLE) AS total, count(*) AS days FROM iy GROUP BY iso), im AS (SELECT indicator, iso, count(*) AS n, total / count(*) * sum(1 / v) AS model, any_value(total) AS total, any_value(days) AS days FROM ie JOIN iu USING (iso) GROUP BY indicator, iso, total),
ic AS (SELECT iso, total / count(*) * sum(1 / v) AS dca FROM (SELECT *, row_number() OVER ({Q.O}) - 1 AS pos FROM iy) JOIN iu USING (iso) WHERE pos % 5 = 0 GROUP BY iso, total),
ir AS (SELECT indicator, iso, avg(bought) AS rand FROM (SELECT indicator, iso, trial, sum(total / n / v) AS bought FROM (SELECT im.indicator, iy.iso, v, total, n, trial, row_number() OVER (PARTITION BY im.indicator, iy.iso, trial ORDER BY {Q.md5_key(0, 'trial', "im.indicator || '|' || iy.iso", 'iy.quote_date')}) AS place FROM iy JOIN im USING (iso), (SELECT unnest(range(500)) AS trial) WHERE days > n) WHERE place <= n GROUP BY ALL) GROUP BY ALL),
ih AS (SELECT *, {held}, row_number() OVER ({Q.O}) AS pos, count(*) OVER (PARTITION BY iso) AS n FROM p), ia AS (SELECT iso, {', '.join(f'avg(CAST({c} AS INT)) FILTER (pos <= n - {c[1:]}) AS base_{c}' for c in flags)} FROM ih GROUP BY iso),
io AS (SELECT indicator, ie.iso, {', '.join(f'avg(CAST({c} AS INT)) AS hit_{c}' for c in flags)} FROM ie JOIN ih ON ih.iso = ie.iso AND ih.quote_date = ie.quote_date GROUP BY ALL),
ig AS (SELECT indicator, iso, count(*) FILTER (gap <= 5) / count(*)::DOUBLE AS series_share FROM (SELECT *, date_diff('day', lag(quote_date) OVER (PARTITION BY indicator, iso ORDER BY quote_date), quote_date) AS gap FROM ie) GROUP BY ALL),
ix AS (SELECT indicator, iso, params, speed, CASE WHEN closing THEN 'window_closing' ELSE 'favourable_now' END AS scenario, coalesce(im.n, 0) AS n_signals, (model - dca) / dca * 100 AS dca, (model - rand) / rand * 100 AS uplift_vs_random,
  {own(lift, 'c5', 'f5')} AS lift, {own(lift, 'f5', 'c5')} AS lift_h5_other, {own('hit_{0}', 'c5', 'f5')} AS hit_rate_h5, {own('hit_{0}', 'c15', 'f15')} AS hit_rate_h15, im.n / (iu.days / 5.0) AS pw, series_share
  FROM ip JOIN it USING (indicator) JOIN iu USING (iso) LEFT JOIN im USING (indicator, iso) LEFT JOIN ic USING (iso) LEFT JOIN ir USING (indicator, iso) LEFT JOIN io USING (indicator, iso) LEFT JOIN ia USING (iso) LEFT JOIN ig USING (indicator, iso))"""


_MATRIX = ("uplift_vs_dca", "uplift_vs_random", "lift_h5", "lift_h5_other", "hit_rate_h5", "hit_rate_h15", "per_week", "series_share")
_MATRIX_SQL = {"uplift_vs_dca": "dca", "lift_h5": "lift", "per_week": "pw"}


def _matrix(found):
    return rounded(found, *_MATRIX, digits=4, keep=("indicator", "iso", "params", "speed", "scenario", "n_signals", "verdict", "reason"))


@query("indicator_matrix")
def _(s, d):
    return _matrix(E.indicator_matrix(p1(s, d), M.walk_forward_ridge(features(s, d), p1(s, d)))[0])


@query("indicator_matrix_rules", on_p("SELECT indicator, iso, params, speed, scenario, n_signals, verdict, reason, " + ", ".join(r(_MATRIX_SQL.get(c, c), c, 4) for c in _MATRIX) + f" FROM ({_VERDICT} ix)", _grid_sql(), _matrix_sql()))
def _(s, d):
    return _matrix(E.indicator_matrix(p1(s, d))[0])


@query("calibrated_waiting_cost", on_p(f"""SELECT iso, 'value' AS fast, 'reversal_from_min' AS slow, count(*) AS n_pairs, {r('quantile_cont((b.v / a.v - 1) * 10000, 0.5)', 'waiting_cost_bps', 4)} FROM (SELECT f.iso, f.quote_date AS f, min(w.quote_date) AS t FROM iall f JOIN iall w ON w.iso = f.iso AND w.quote_date > f.quote_date WHERE f.indicator = 'value' AND w.indicator = 'reversal_from_min' GROUP BY 1, 2) m
JOIN p a USING (iso) JOIN p b USING (iso) WHERE a.quote_date = f AND b.quote_date = t GROUP BY iso""", _grid_sql(), _matrix_sql()))
def _(s, d):
    return rounded(E.indicator_matrix(p1(s, d))[1], "waiting_cost_bps", digits=4, keep=("iso", "fast", "slow", "n_pairs"))


@query("trailing_year", on_p("SELECT iso, quote_date, round(v, 6) AS rub_per_unit, sig AS is_signal, pos % 5 = 0 AS is_regular FROM (SELECT p.iso, p.quote_date, v, fa.quote_date IS NOT NULL AS sig, row_number() OVER (PARTITION BY p.iso ORDER BY p.quote_date) - 1 AS pos FROM p LEFT JOIN fa USING (iso, quote_date) JOIN (SELECT iso, CAST(max(quote_date) - to_months(12) AS DATE) AS since FROM p GROUP BY iso) y ON y.iso = p.iso AND p.quote_date >= since)", _POS, _PAIR))
def _(s, d):
    return E.trailing_year(p1(s, d), I.value(p1(s, d))).select("iso", "quote_date", F.round(V, 6).alias(V), "is_signal", "is_regular")


# The signal table, models and the audit


def _signal_sql(p: str = Q.P) -> str:
    gated = "sc AS (SELECT *, CASE WHEN dev < 0 THEN plain ELSE -1e6 END AS score FROM tn WHERE plain IS NOT NULL)"
    facts = f"fx AS (SELECT iso, quote_date, v / {Q.lag('v', 5)} - 1 AS ret, CASE WHEN len(w) + 1 >= 20 THEN len(list_filter(w, lambda x: x > v)) * 100.0 / len(w) END AS lp FROM (SELECT *, coalesce(list(v) {Q.over(-89, -1)}, []) AS w FROM p))"
    ranks = f"sk AS ({Q.ranked('th', 'score', 250, 20, 'sp')})"
    ctes = ", ".join((_span_tuning(p), gated, _policy("-500000.0"), _DEC, facts, ranks))
    return f"""WITH RECURSIVE {ctes} SELECT sk.quote_date AS signal_date, sk.iso, 'zscore_tuned' AS indicator, CASE WHEN ret < 0 THEN 'down' ELSE 'up' END AS direction, {r('sk.score', 'strength')}, {r('sp', 'strength_pct')},
    CASE WHEN span <= 10 THEN 'fast' WHEN span <= 60 THEN 'medium' ELSE 'slow' END AS speed, 'favourable_now' AS scenario, chosen AS "window", {r('sk.v', V)}, {r('lp', 'level_percentile')}, {r('dev', 'deviation_pct')},
    CASE WHEN dev < 0 THEN 'Курс ' || sk.iso || ' сейчас на ' || replace(printf('%.1f', abs(dev)), '.', ',') || '% ниже своего среднего за последние ' || span || ' наблюдений.' ELSE '' END AS message
    FROM sk JOIN dec ON dec.iso = sk.iso AND dec.quote_date = sk.quote_date JOIN fx ON fx.iso = sk.iso AND fx.quote_date = sk.quote_date WHERE dec.reason = 'selected'"""


@query("signal_table", _signal_sql())
def _(s, d):
    df = S.signal_table(p1(s, d))
    return df.select("signal_date", "iso", "indicator", "direction", F.round("strength", 6).alias("strength"), F.round("strength_pct", 6).alias("strength_pct"), "speed", "scenario", "window", F.round(V, 6).alias(V), F.round("level_percentile", 6).alias("level_percentile"), F.round("deviation_pct", 6).alias("deviation_pct"), "message")


_ASOF = Q.P.replace("FROM raw)", "FROM raw WHERE quote_date + 1 <= DATE '2000-06-30')")


@query("signals_asof", f'SELECT signal_date, iso, "window", strength FROM ({_signal_sql(_ASOF)})')
def _(s, d):
    return S.signals_asof(p1(s, d), "2000-06-30").select("signal_date", "iso", "window", F.round("strength", 6).alias("strength"))


# The stand: what a page that walks day by day is served, and its export

_START, _SIM = "2000-01-01", "2000-06-30"
_AUDITED = ["2000-06-30", "2001-03-15"]
_DRAWN_SIG = f"""sig AS ({_signal_sql().replace(', 6) AS', ', 14) AS')}), dw AS (SELECT *, abs(v / {Q.lag('v')} - 1) * 10000 AS move FROM p WHERE quote_date >= DATE '{_START}'), ds AS (SELECT *, TRY_CAST(split_part("window", '=', 2) AS INT) AS span FROM sig WHERE signal_date >= DATE '{_START}'),
us AS (SELECT iso, min_by(span, (-n, f)) AS trend_span FROM (SELECT iso, span, count(*) AS n, min(signal_date) AS f FROM ds GROUP BY iso, span) GROUP BY iso),
cr AS (SELECT iso, iso AS name, '' AS country, min(quote_date) AS first_date, max(quote_date) AS last_date, DATE '{_SIM}' AS sim_start, round(coalesce(quantile_cont(move, 0.5), 50), 1) AS threshold_bps FROM dw GROUP BY iso), cd AS (SELECT cr.*, coalesce(trend_span, 10) AS trend_span FROM cr LEFT JOIN us USING (iso))"""
_TREND = f"tr2 AS (SELECT * FROM (SELECT iso, quote_date, round(v, 6) AS rate, round(list_reduce(list(v) {Q.over('UNBOUNDED PRECEDING', 0)}, lambda y, x: (1 - 2.0::DOUBLE / (trend_span + 1)) * y + 2.0::DOUBLE / (trend_span + 1) * x), 6) AS trend FROM p JOIN cd USING (iso)) WHERE quote_date >= DATE '{_START}')"


def _stand(s, d):
    panel = cut_lineage(p1(s, d))
    return panel, cut_lineage(S.signal_table(panel))


@query("stand_corridors", on_p("SELECT * FROM cd", _DRAWN_SIG))
def _(s, d):
    return D.corridors(*_stand(s, d), _START, _SIM)


@query("stand_trend", on_p("SELECT iso, quote_date, rate, trend FROM tr2", _DRAWN_SIG, _TREND))
def _(s, d):
    panel, sent = _stand(s, d)
    return D.trend_series(panel, D.corridors(panel, sent, _START, _SIM), _START)


@query("stand_days", on_p(f"""SELECT c.iso, c.day, v IS NOT NULL AS has_quote, round(v, 6) AS rate, CASE WHEN signal_date IS NULL THEN 'hold' ELSE 'candidate' END AS decision, {r('deviation_pct', 'deviation_pct', 3)}, CAST(coalesce(span, CASE WHEN signal_date IS NOT NULL THEN 0 END) AS INT) AS span, message AS client_message
FROM (SELECT iso, CAST(unnest(generate_series(first_date, last_date, INTERVAL 1 DAY)) AS DATE) AS day FROM cd) c LEFT JOIN dw ON dw.iso = c.iso AND dw.quote_date = c.day LEFT JOIN ds ON ds.iso = c.iso AND ds.signal_date = c.day""", _DRAWN_SIG))
def _(s, d):
    days = D.day_log(*_stand(s, d), _START)
    return days.select("iso", "day", "has_quote", "rate", "decision", F.col("signal.deviation_pct").alias("deviation_pct"), F.col("signal.span").alias("span"), F.col("signal.client_message").alias("client_message"))


@query("stand_lookup", on_p("SELECT c.iso, c.day, v IS NOT NULL AS has_quote, round(v, 6) AS rate, CASE WHEN signal_date IS NULL THEN 'hold' ELSE 'candidate' END AS decision FROM (SELECT 'RRR' AS iso, DATE '2000-07-01' AS day) c LEFT JOIN dw ON dw.iso = c.iso AND dw.quote_date = c.day LEFT JOIN ds ON ds.iso = c.iso AND ds.signal_date = c.day", _DRAWN_SIG))
def _(s, d):
    at = free_folder(s, "days")
    D.store_days(D.day_log(*_stand(s, d), _START), at)
    return D.look_up(s, at, "rrr", "2000-07-01").select("iso", "day", "has_quote", "rate", "decision")


@query("stand_stats", on_p(f"""SELECT iso, coalesce(n, 0) AS n_signals, round(coalesce(n, 0) / w, 2) AS per_week, md AS median_move_bps, p9 AS p90_move_bps, lr AS last_rate, ld AS last_date FROM (SELECT iso, date_diff('day', min(quote_date), max(quote_date)) / 7.0::DOUBLE AS w, round(quantile_cont(move, 0.5), 1) AS md, round(quantile_cont(move, 0.9), 1) AS p9,
round(max_by(v, quote_date), 6) AS lr, max(quote_date) AS ld FROM dw GROUP BY iso) LEFT JOIN (SELECT iso, count(*) AS n FROM ds GROUP BY iso) USING (iso)""", _DRAWN_SIG))
def _(s, d):
    return D.statistics(*_stand(s, d), _START)


_EXPORTED = f"""fw AS (SELECT iso, quote_date, {', '.join(f"lead(quote_date, {i}) OVER ({Q.O}) AS d{i}, lead(v, {i}) OVER ({Q.O}) AS r{i}" for i in range(1, 6))}, avg(v) {Q.over(1, 10)} AS m, v FROM p)"""


@query("stand_export", on_p(f"""SELECT ds.iso, ds.signal_date AS date, round(ds.rub_per_unit, 6) AS rate, CAST((d1 IS NOT NULL)::INT + (d2 IS NOT NULL)::INT + (d3 IS NOT NULL)::INT + (d4 IS NOT NULL)::INT + (d5 IS NOT NULL)::INT AS BIGINT) AS n_follow, round((r1 / v - 1) * 10000, 1) AS first_bps, round((r5 / v - 1) * 10000, 1) AS fifth_bps,
round((m / v - 1) * 10000, 1) AS forward_bps, round(deviation_pct, 3) AS deviation_pct, "window", span, speed, round(strength_pct, 4) AS strength_pct, round(level_percentile, 1) AS level_percentile, direction, message FROM ds JOIN fw ON fw.iso = ds.iso AND fw.quote_date = ds.signal_date""", _DRAWN_SIG, _EXPORTED))
def _(s, d):
    at = free_folder(s, "export")
    D.write_export(D.export_pieces(*_stand(s, d), _START, _SIM, _AUDITED[:1]), at)
    read, follow = D.read_export(s, at, "signals"), F.col("follow")
    return read.select("iso", "date", "rate", F.size(follow).cast("long").alias("n_follow"), F.get(follow, 0)["bps"].alias("first_bps"), F.get(follow, 4)["bps"].alias("fifth_bps"), "forward_bps", "deviation_pct", "window", "span", "speed", "strength_pct", "level_percentile", "direction", "message")


@query("stand_audit", on_p(" UNION ALL ".join(f"SELECT DATE '{x}' AS asof, iso, count(*) FILTER (signal_date >= DATE '{_START}' AND signal_date <= DATE '{x}') AS n, true AS identical, coalesce(bool_or(signal_date = DATE '{x}'), false) AS fired_today FROM (SELECT DISTINCT iso FROM p) LEFT JOIN sig USING (iso) GROUP BY iso" for x in _AUDITED), _DRAWN_SIG))
def _(s, d):
    panel, sent = _stand(s, d)
    return D.signal_audit(panel, sent, _AUDITED, _START)


@query("corridor_bundle", on_p(f"""SELECT iso, quote_date, round(v, 6) AS rate, mo AS model, pos % 5 = 0 AS regular, coalesce(days > n AND dr <= n, false) AS random FROM (SELECT y.*, n, fa.quote_date IS NOT NULL AS mo, row_number() OVER (PARTITION BY y.iso ORDER BY y.quote_date) - 1 AS pos, count(*) OVER (PARTITION BY y.iso) AS days, row_number() OVER (PARTITION BY y.iso ORDER BY {Q.md5_key(0, "0", 'y.iso', 'y.quote_date')}) AS dr
FROM (SELECT * FROM p WHERE quote_date >= (SELECT CAST(max(quote_date) - to_months(12) AS DATE) FROM p)) y LEFT JOIN fa USING (iso, quote_date) LEFT JOIN (SELECT iso, count(*) AS n FROM fa WHERE quote_date >= (SELECT CAST(max(quote_date) - to_months(12) AS DATE) FROM p) GROUP BY iso) USING (iso))""", _POS, _PAIR))
def _(s, d):
    return D.corridor_bundle(p1(s, d), I.value(p1(s, d))).withColumn("rate", F.round("rate", 6))


# Chart tables, read from what an evaluation has stored


def _stored(s, d):
    at, found = free_folder(s, "artefacts"), _benched(s, d)
    C.sinks.write_artefacts({"per_corridor": found.corridors, "leaderboard": found.leaderboard}, at)
    return lambda name: C.sinks.read_artefact(s, at, name)


@query("chart_corridors", _bench_sql(f"SELECT strategy, iso, {r('currency_uplift_bps', 'currency_uplift_bps', 4)}, {r('q_value', 'q_value', 4)}, coalesce(q_value <= 0.05, false) AS solid, count(*) FILTER (currency_uplift_bps > 0) OVER (PARTITION BY strategy) AS n_positive, count(*) OVER (PARTITION BY strategy) AS n_series FROM co WHERE strategy IN ('percentile', 'oracle')", _DRAWN, _CORRIDOR))
def _(s, d):
    return rounded(H.corridor_points(_stored(s, d)("per_corridor"), ["percentile", "oracle"]), "currency_uplift_bps", "q_value", digits=4, keep=("strategy", "iso", "solid", "n_positive", "n_series"))


@query("chart_rules", _bench_sql(f"SELECT CAST(row_number() OVER (ORDER BY currency_uplift_bps DESC, strategy) AS INT) AS place, strategy, {r('currency_uplift_bps', 'currency_uplift_bps', 4)}, corridors_positive, n_corridors, false AS is_model FROM bo WHERE strategy IN ('percentile', 'reversal') AND currency_uplift_bps IS NOT NULL", _DRAWN, _CORRIDOR, _ROLLED))
def _(s, d):
    return rounded(H.rules_comparison(_stored(s, d)("leaderboard")), "currency_uplift_bps", digits=4, keep=("place", "strategy", "corridors_positive", "n_corridors", "is_model"))


@query("chart_rate", _bench_sql("SELECT quote_date, round(v, 6) AS rate, coalesce(m, 0) AS n_marks, coalesce(f, '') AS strategies FROM p LEFT JOIN (SELECT quote_date, count(*) AS m, string_agg(strategy, ',' ORDER BY strategy) AS f FROM sg WHERE iso = 'RRR' GROUP BY quote_date) USING (quote_date) WHERE iso = 'RRR' AND quote_date >= DATE '2000-01-01'"))
def _(s, d):
    at, panel = free_folder(s, "artefacts"), cut_lineage(p1(s, d))
    C.sinks.write_artefacts({"signals": B.evaluated(panel, _SPEC, list(_NAMED), usd(s, d))[0]}, at)
    found = H.rate_points(panel, C.sinks.read_artefact(s, at, "signals"), "RRR", "2000-01-01")
    return found.select("quote_date", F.round("rate", 6).alias("rate"), F.greatest(F.size("marks"), F.lit(0)).cast("long").alias("n_marks"), F.array_join(F.coalesce(F.col("marks.strategy"), F.array().cast("array<string>")), ",").alias("strategies"))


@query("chart_ladder")
def _(s, d):
    at, steps = free_folder(s, "artefacts"), [name for name, _ in H.LADDER]
    C.sinks.write_artefacts({"leaderboard": B.run_benchmark(p1(s, d), names=steps, usd=usd(s, d)).leaderboard}, at)
    return rounded(H.ladder(C.sinks.read_artefact(s, at, "leaderboard")), "currency_uplift_bps", digits=4, keep=("step", "strategy", "label", "shipped"))


@query("chart_cadence")
def _(s, d):
    at = free_folder(s, "artefacts")
    C.sinks.write_artefacts({"cadence_sweep": _swept(s, d, ["oracle", "percentile"])}, at)
    return H.cadence_line(C.sinks.read_artefact(s, at, "cadence_sweep"))


@query("ridge_asof")
def _(s, d):
    panel, built = p1(s, d), cut_lineage(features(s, d))
    return rounded(M.ridge_asof(cut_lineage(M.ridge_snapshots(built, panel)), built, panel, "2000-06-30"), "prediction", keep=("iso", "quote_date", "available_on"))


@query("freshness_levels", on_p(f"""SELECT t.iso, t.quote_date AS signal_date, {r('(n.v / t.v - 1) * 10000', 'delta_bps', 4)}, CASE WHEN abs((n.v / t.v - 1) * 10000) <= 0.5 THEN 'same' WHEN n.v < t.v THEN 'better' WHEN (n.v / t.v - 1) * 10000 <= 50 THEN 'mild' ELSE 'stale' END AS level
FROM p t JOIN fa USING (iso, quote_date) JOIN (SELECT iso, max_by(v, quote_date) AS v FROM p WHERE available_on <= DATE '2000-06-30' GROUP BY iso) n ON n.iso = t.iso WHERE t.quote_date <= DATE '2000-06-30'""", _POS, _PAIR))
def _(s, d):
    return rounded(S.freshness(I.value(p1(s, d)), p1(s, d), "2000-06-30"), "delta_bps", digits=4, keep=("iso", "signal_date", "level"))


@query("ridge_predictions")
def _(s, d):
    return rounded(M.walk_forward_ridge(features(s, d), p1(s, d)), "prediction")


@query("utility_risk_scores")
def _(s, d):
    return rounded(M.walk_forward_heads(p1(s, d), features(s, d)), "p_min", "p_bad", "u_bps", "risk_bps", "score", digits=4)


@query("utility_risk_coefficients")
def _(s, d):
    config = M.UtilityRiskConfig()
    return M.walk_forward_coefficients(M.heads_data(p1(s, d), features(s, d), config), config).drop("turn")


@query("lookahead_audit")
def _(s, d):
    found = B.audit_no_lookahead(p1(s, d), usd(s, d), B.score_builders(), n_dates=3)
    return rounded(found, "historical_score", "asof_score", keep=("score_name", "iso", "cut", "matched", "reason"))


@query("lambda_sweep")
def _(s, d):
    panel = p1(s, d)
    return B.lambda_sweep(cut_lineage(M.walk_forward_heads(panel, features(s, d))), B.evaluated_days(panel, _SPEC), _SPEC.policy)


@query("evenly_spaced", on_p(f"SELECT iso, quote_date FROM (SELECT *, row_number() OVER ({Q.O}) - 1 AS pos, count(*) OVER (PARTITION BY iso) AS n FROM p) WHERE list_contains([CAST(floor(i * (n - 1) / 11.0::DOUBLE) AS BIGINT) for i in range(12)], pos)"))
def _(s, d):
    return B.evenly_spaced(p1(s, d), 12).select("iso", "quote_date")


@query("regular_days", on_p(f"SELECT iso, quote_date FROM (SELECT *, row_number() OVER ({Q.O}) - 1 AS pos FROM p) WHERE pos % 5 = 0"))
def _(s, d):
    return U.regular_days(p1(s, d)).select("iso", "quote_date")


@query("following_quotes", on_p(" UNION ALL ".join(f"SELECT * FROM (SELECT iso, quote_date, {i} AS step, lead(quote_date, {i}) OVER ({Q.O}) AS next_date, {r(f'(lead(v, {i}) OVER ({Q.O}) / v - 1) * 10000', 'drift_bps', 4)} FROM p) WHERE next_date IS NOT NULL" for i in range(1, 6))))
def _(s, d):
    return rounded(I.following_quotes(p1(s, d)), "drift_bps", digits=4, keep=("iso", "quote_date", "step", "next_date"))


@query("usual_choice", f"WITH {_span_tuning()} SELECT iso, min_by(chosen, (-n, chosen)) AS chosen, max(n) AS n FROM (SELECT iso, chosen, count(*) AS n FROM tn WHERE plain IS NOT NULL GROUP BY iso, chosen) GROUP BY iso")
def _(s, d):
    return I.usual_choice(S.tuned_scores(p1(s, d)))


@query("daily_payload")
def _(s, d):
    return I.daily_payload(p1(s, d))


@query("hourly_events", """SELECT event_type AS iso, date_trunc('hour', ts) AS quote_hour, count(*) AS nominal, round(avg(value), 6) AS rub_per_unit FROM events GROUP BY 1, 2""")
def _(s, d):
    return N.hourly_events(table(s, d, "events")).select("iso", F.col("quote_hour").cast("timestamp_ntz").alias("quote_hour"), "nominal", F.round("rub_per_unit", 6).alias("rub_per_unit"))

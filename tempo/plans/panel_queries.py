"""Queries over sources, windows, features and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempo.functions import windows as W
from tempo.operators import features as X
from tempo.operators import signals as S
from tempo.plans import sql as Q
from tempo.sources import panel as N

V = "rub_per_unit"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1(spark, sf_dir):
    return N.shipment_panel(table(spark, sf_dir, "lineitem"))


def usd(spark, sf_dir):
    return N.context_panel(table(spark, sf_dir, "lineitem"))


def features(spark, sf_dir):
    return X.compute_features(p1(spark, sf_dir), usd(spark, sf_dir))


def rounded(df, *names, digits=6, keep=("iso", "quote_date")):
    return df.select(*keep, *[F.round(F.col(n).cast("double"), digits).alias(n) for n in names])


def r(expr, name, digits=6):
    return f"round(CAST({expr} AS DOUBLE), {digits}) AS {name}"


QUERIES = {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = (f, sql)
        return f

    return put


def on_p(body: str, *ctes: str) -> str:
    return f"WITH {', '.join((Q.P, *ctes))} {body}"


@query("norm_panel", on_p(f"SELECT quote_date, available_on, iso, nominal, {r('rate', 'rate', 2)}, {r('v', V)} FROM p"))
def _(s, d):
    return p1(s, d).select("quote_date", "available_on", "iso", "nominal", F.round("rate", 2).alias("rate"), F.round(V, 6).alias(V))


@query("validate_quotes", f"""WITH {Q.RAW}, c AS (SELECT *, count(*) OVER (PARTITION BY quote_date, iso) AS copies FROM raw)
SELECT count(*) FILTER (quote_date IS NULL) AS bad_date, count(*) FILTER (NOT regexp_full_match(iso, '[A-Z]{{3}}')) AS bad_iso, count(*) FILTER (nominal IS NULL OR nominal <= 0) AS bad_nominal,
count(*) FILTER (rate IS NULL OR isnan(rate) OR isinf(rate) OR rate <= 0) AS bad_rate, count(*) FILTER (abs(nominal - round(nominal)) > 1e-8 + 1e-5 * abs(nominal)) AS not_whole,
count(*) FILTER (false) AS bad_unit_rate, count(*) FILTER (copies > 1) AS duplicates FROM c""")
def _(s, d):
    return N.violations(N.coerced(N.shipment_quotes(table(s, d, "lineitem"))))


@query("asof_snapshot", on_p(f"SELECT quote_date, available_on, iso, {r('v', V)} FROM p WHERE available_on <= DATE '1998-09-02'"))
def _(s, d):
    return rounded(N.as_of(p1(s, d), "1998-09-02"), V, keep=("quote_date", "available_on", "iso"))


@query("latest_quote", on_p(f"SELECT iso, max(quote_date) AS quote_date, {r('max_by(v, quote_date)', V)} FROM p WHERE available_on <= DATE '1998-09-02' GROUP BY iso"))
def _(s, d):
    return rounded(N.latest_quotes(p1(s, d), "1998-09-02"), V)


@query("readiness", on_p("SELECT iso, count(*) AS n_quotes, max(available_on) AS available_until FROM p GROUP BY iso"))
def _(s, d):
    return N.readiness(p1(s, d))


@query("order_panel", """WITH q AS (SELECT CAST(o_orderdate AS DATE) AS quote_date, CASE left(o_orderpriority, 1) WHEN '1' THEN 'URG' WHEN '2' THEN 'HIG' WHEN '3' THEN 'MED' WHEN '4' THEN 'NOT' ELSE 'LOW' END AS iso,
count(*) AS nominal, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS rate FROM orders GROUP BY 1, 2) SELECT quote_date, iso, nominal, round(rate / nominal, 6) AS rub_per_unit FROM q""")
def _(s, d):
    return rounded(N.order_panel(table(s, d, "orders")), V, keep=("quote_date", "iso", "nominal"))


_REL = f"rel AS (SELECT *, v / {Q.lag('v')} AS rel FROM p)"


@query("denom_breaks", on_p(f"SELECT iso, quote_date, {r('rel', 'rel')} FROM rel WHERE rel > 1.6 OR rel < 1 / 1.6::DOUBLE", _REL))
def _(s, d):
    return rounded(N.series_breaks(p1(s, d), 1.6), "rel")


@query("after_last_break", on_p(f"SELECT iso, quote_date, {r('v', V)} FROM (SELECT *, max(CASE WHEN rel > 1.6 OR rel < 1 / 1.6::DOUBLE THEN quote_date END) OVER (PARTITION BY iso) AS b FROM rel) WHERE b IS NULL OR quote_date > b", _REL))
def _(s, d):
    return rounded(N.after_last_break(p1(s, d), 1.6), V)


@query("first_quotes", """SELECT date, iso, event_id, round(value, 6) AS value FROM (SELECT CAST(ts AS DATE) AS date, event_type AS iso, event_id, value, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def _(s, d):
    raw = table(s, d, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("iso"), "event_id", F.round("value", 6).alias("value"))
    return N.first_quotes(raw, "event_id")


@query("window_ids", on_p(f"SELECT quote_date, iso, {Q.week('available_on')} AS week_id, strftime(available_on, '%Y-%m') AS month_id FROM p"))
def _(s, d):
    return p1(s, d).select("quote_date", "iso", W.window_id("available_on", "week").alias("week_id"), W.window_id("available_on", "month").alias("month_id"))


_RET = "ret AS (SELECT *, " + ", ".join(f"ln(v / {Q.lag('v', n)}) AS ret_{n}" for n in (1, 5, 10, 20)) + " FROM p)"
_RETS = ", ".join(r(f"ret_{n}", f"ret_{n}", 8) for n in (1, 5, 10, 20))


@query("returns_lags", on_p(f"SELECT iso, quote_date, {_RETS} FROM ret", _RET))
def _(s, d):
    return rounded(p1(s, d).withColumns({f"ret_{n}": W.log_return(V, n) for n in (1, 5, 10, 20)}), "ret_1", "ret_5", "ret_10", "ret_20", digits=8)


@query("accel_5", on_p(f"SELECT iso, quote_date, {r('ret_5 - ' + Q.lag('ret_5', 5), 'accel_5', 8)} FROM ret", _RET))
def _(s, d):
    df = p1(s, d).withColumn("ret_5", W.log_return(V, 5))
    return rounded(df.withColumn("accel_5", F.col("ret_5") - F.lag("ret_5", 5).over(W.o())), "accel_5", digits=8)


@query("vol_20_ratio", on_p(f"SELECT iso, quote_date, {r('v20', 'vol_20', 8)}, {r('v20 / nullif(v60, 0)', 'vol_ratio')} FROM (SELECT *, {Q.roll('stddev_samp', 'ret_1', 20, 5)} AS v20, {Q.roll('stddev_samp', 'ret_1', 60, 10)} AS v60 FROM ret)", _RET))
def _(s, d):
    df = p1(s, d).withColumn("ret_1", W.log_return(V, 1)).withColumns({"vol_20": W.roll(F.stddev_samp, "ret_1", 20, 5), "v60": W.roll(F.stddev_samp, "ret_1", 60, 10)})
    return rounded(df.withColumn("vol_ratio", F.col("vol_20") / F.nullif(F.col("v60"), F.lit(0.0))), "vol_20", digits=8).join(rounded(df.withColumn("vol_ratio", F.col("vol_20") / F.nullif(F.col("v60"), F.lit(0.0))), "vol_ratio"), ["iso", "quote_date"])


@query("drawdown_60", on_p(f"SELECT iso, quote_date, {r('(h - v) / h', 'drawdown_60', 8)} FROM (SELECT *, {Q.roll('max', 'v', 60, 5)} AS h FROM p)"))
def _(s, d):
    high = W.roll(F.max, V, 60, 5)
    return rounded(p1(s, d).withColumn("drawdown_60", (high - F.col(V)) / high), "drawdown_60", digits=8)


@query("dist_min_90", on_p(f"SELECT iso, quote_date, {r('(v - l) / l', 'dist_to_min_90', 8)} FROM (SELECT *, {Q.roll('min', 'v', 90, 20)} AS l FROM p)"))
def _(s, d):
    low = W.roll(F.min, V, 90, 20)
    return rounded(p1(s, d).withColumn("dist_to_min_90", (F.col(V) - low) / low), "dist_to_min_90", digits=8)


@query("down_streak", on_p("SELECT iso, quote_date, CAST(down_streak AS BIGINT) AS down_streak FROM streak", Q.STREAK))
def _(s, d):
    return W.with_streak(p1(s, d), V, "down_streak").select("iso", "quote_date", F.col("down_streak").cast("long").alias("down_streak"))


@query("rolling_rank_90", on_p(f"SELECT iso, quote_date, {r('k', 'pct_rank_90')} FROM ({Q.ranked('p', 'v', 90, 20, 'k')})"))
def _(s, d):
    return rounded(p1(s, d).withColumn("pct_rank_90", W.rolling_rank(V, 90, 20)), "pct_rank_90")


@query("level_percentile", on_p(f"SELECT iso, quote_date, {r('CASE WHEN len(w) + 1 >= 20 THEN len(list_filter(w, lambda x: x > v)) * 100.0 / len(w) END', 'level_percentile')} FROM (SELECT *, coalesce(list(v) {Q.over(-89, -1)}, []) AS w FROM p)"))
def _(s, d):
    return rounded(p1(s, d).withColumn("level_percentile", W.share_above_today(V, 90, 20)), "level_percentile")


_Z = Q.zscore("p", 60, "z")


@query("ewma_60", on_p(f"SELECT iso, quote_date, {r('m_60', 'ewma_60')} FROM z_m", _Z))
def _(s, d):
    return rounded(W.with_ewma(p1(s, d), V, (60,)).withColumnRenamed("mean_60", "ewma_60"), "ewma_60")


@query("ew_zscore", on_p(f"SELECT iso, quote_date, {r('z_60', 'ewma_zscore')} FROM z", _Z))
def _(s, d):
    return rounded(W.with_ewma(p1(s, d), V, (60,)).withColumn("ewma_zscore", W.ew_zscore(V, 60)), "ewma_zscore")


_RES = "rs AS (SELECT *, v - m_60 AS res FROM z_m)"


@query("residual_pct_250", on_p(f"SELECT iso, quote_date, {r('k', 'residual_pct')} FROM ({Q.ranked('rs', 'res', 250, 20, 'k')})", _Z, _RES))
def _(s, d):
    df = W.with_ewma(p1(s, d), V, (60,)).withColumn("residual", F.col(V) - F.col("mean_60"))
    return rounded(df.withColumn("residual_pct", W.rolling_rank("residual", 250, 20)), "residual_pct")


_MONTH = "OVER (PARTITION BY iso, month(quote_date) ORDER BY quote_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
_SEAS = f"sea AS (SELECT *, CASE WHEN count(v) {_MONTH} >= 3 THEN (v - avg(v) {_MONTH}) / nullif(stddev_samp(v) {_MONTH}, 0) END AS sz FROM p)"


@query("seasonal_lag5", on_p(f"SELECT iso, quote_date, {r('sz', 'seasonal_zscore')} FROM sea", _SEAS))
def _(s, d):
    return rounded(p1(s, d).withColumn("seasonal_zscore", X.seasonal_zscore()), "seasonal_zscore")


@query("calendar_feats", on_p(f"""SELECT iso, quote_date, {r('sin(month(quote_date) * 2 * pi() / 12)', 'month_sin')}, {r('cos(month(quote_date) * 2 * pi() / 12)', 'month_cos')}, {r('sin(day(quote_date) * 2 * pi() / 31)', 'dom_sin')}, {r('cos(day(quote_date) * 2 * pi() / 31)', 'dom_cos')},
CAST(day(last_day(quote_date)) - day(quote_date) AS BIGINT) AS days_to_eom, CAST(day(quote_date) <= 5 AS BIGINT) AS is_month_start, CAST(day(last_day(quote_date)) - day(quote_date) < 5 AS BIGINT) AS is_month_end FROM p"""))
def _(s, d):
    df = X.calendar(p1(s, d))
    return df.select("iso", "quote_date", *[(F.round(c, 6) + 0.0).alias(c) for c in ("month_sin", "month_cos", "dom_sin", "dom_cos")], *[F.col(c).cast("long").alias(c) for c in ("days_to_eom", "is_month_start", "is_month_end")])


_USD = f"{Q.USD}, us AS (SELECT 'USD' AS iso, * FROM u), um AS ({Q.ewma('us', 'v', 60, 'm')})"


@query("usd_broadcast_join", on_p(f"SELECT p.iso, p.quote_date, {r('um.v / um.m - 1', 'rub_strength', 8)} FROM p LEFT JOIN um USING (quote_date)", _USD))
def _(s, d):
    return rounded(p1(s, d).join(X.usd_strength(usd(s, d)), "quote_date", "left"), "rub_strength", digits=8)


_ALL = ", ".join((_Z, _RES, _RET, Q.STREAK, _SEAS, f"rk AS ({Q.ranked('p', 'v', 90, 20, 'k')})", f"dd AS (SELECT iso, quote_date, (h - v) / h AS dd, (v - l) / l AS dm FROM (SELECT *, {Q.roll('max', 'v', 60, 5)} AS h, {Q.roll('min', 'v', 90, 20)} AS l FROM p))",
"""ru AS (SELECT p.iso, p.quote_date, p.available_on, p.v, 1 - rk.k AS percentile, -z.z_60 AS zscore, streak.down_streak - ret.ret_5 AS momentum, dd.dd AS drawdown, -sea.sz AS seasonal,
CASE WHEN ret.ret_1 > 0 THEN -dd.dm ELSE -1e6 END AS reversal, -dd.dm AS near_min, coalesce(CAST(ret.ret_1 > 0 AS INT), 0) AS turned_up
FROM p JOIN rk USING (iso, quote_date) JOIN z USING (iso, quote_date) JOIN streak USING (iso, quote_date) JOIN ret USING (iso, quote_date) JOIN dd USING (iso, quote_date) JOIN sea USING (iso, quote_date))"""))


@query("rules_six", on_p("SELECT iso, quote_date, " + ", ".join(r(c, c) for c in X.RULES) + " FROM ru", _ALL))
def _(s, d):
    f = features(s, d)
    return f.select("iso", "quote_date", *[F.round(X.rule_score(c), 6).alias(c) for c in X.RULES])


@query("rule_matrix", on_p("SELECT iso, quote_date, " + ", ".join(r(c, c) for c in ("percentile", "zscore", "momentum", "drawdown", "seasonal", "near_min", "turned_up")) + " FROM ru", _ALL))
def _(s, d):
    return rounded(X.rule_matrix(features(s, d)), "percentile", "zscore", "momentum", "drawdown", "seasonal", "near_min", "turned_up")


def _rank_chain() -> str:
    source, parts = "ru", []
    for c in X.RULES:
        parts.append(f"rr_{c} AS ({Q.ranked(source, c, 250, 60, 'k_' + c)})")
        source = f"rr_{c}"
    return ", ".join(parts)


@query("trailing_ranks", on_p("SELECT iso, quote_date, " + ", ".join(r("k_" + c, c) for c in X.RULES) + " FROM rr_reversal", _ALL, _rank_chain()))
def _(s, d):
    return rounded(X.trailing_ranks(features(s, d)), *X.RULES)


_KS = ", ".join("k_" + c for c in X.RULES)
_MEAN = f"list_avg(list_filter([{_KS}], lambda x: x IS NOT NULL))"


@query("rank_blend", on_p(f"SELECT iso, quote_date, {r(_MEAN, 'rank_blend')}, {r(f'len(list_filter([{_KS}], lambda x: x > 0.7::DOUBLE)) + {_MEAN}', 'consensus')} FROM rr_reversal", _ALL, _rank_chain()))
def _(s, d):
    return rounded(X.blend_scores(X.trailing_ranks(features(s, d))), "rank_blend", "consensus")


_FEATS = (
    ("z.z_60", "ewma_zscore"), ("rp.rp", "residual_pct"), ("streak.down_streak", "down_streak"), ("ret.ret_1", "ret_1"), ("ret.ret_5", "ret_5"), ("ret.ret_10", "ret_10"), ("ret.ret_20", "ret_20"),
    ("vo.acc", "accel_5"), ("vo.v20", "vol_20"), ("vo.v20 / nullif(vo.v60, 0)", "vol_ratio"), ("dd.dd", "drawdown_60"), ("rk.k", "pct_rank_90"), ("dd.dm", "dist_to_min_90"), ("um.v / um.m - 1", "rub_strength"),
    ("sin(month(p.quote_date) * 2 * pi() / 12)", "month_sin"), ("cos(month(p.quote_date) * 2 * pi() / 12)", "month_cos"), ("sin(day(p.quote_date) * 2 * pi() / 31)", "dom_sin"), ("cos(day(p.quote_date) * 2 * pi() / 31)", "dom_cos"),
    ("sea.sz", "seasonal_zscore"), ("day(last_day(p.quote_date)) - day(p.quote_date)", "days_to_eom"), ("CAST(day(p.quote_date) <= 5 AS INT)", "is_month_start"), ("CAST(day(last_day(p.quote_date)) - day(p.quote_date) < 5 AS INT)", "is_month_end"),
)
_VO = f"vo AS (SELECT iso, quote_date, ret_5 - {Q.lag('ret_5', 5)} AS acc, {Q.roll('stddev_samp', 'ret_1', 20, 5)} AS v20, {Q.roll('stddev_samp', 'ret_1', 60, 10)} AS v60 FROM ret), rp AS ({Q.ranked('rs', 'res', 250, 20, 'rp')})"
_JOINS = " ".join(f"JOIN {t} ON {t}.iso = p.iso AND {t}.quote_date = p.quote_date" for t in ("z", "rp", "streak", "ret", "vo", "dd", "rk", "sea"))


@query("features_all", on_p("SELECT p.iso, p.quote_date, " + ", ".join(r(e, c) for e, c in _FEATS) + f" FROM p {_JOINS} LEFT JOIN um ON um.quote_date = p.quote_date", _ALL, _VO, _USD))
def _(s, d):
    f = features(s, d)
    return f.select("iso", "quote_date", *[(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in X.FEATURES])


@query("deviation_truth", on_p(f"SELECT iso, quote_date, {r('(v / m_60 - 1) * 100', 'deviation_pct')}, v / m_60 - 1 < 0 AS truthful FROM z_m", _Z))
def _(s, d):
    dev = (F.col(V) / F.col("mean_60") - 1) * 100
    return W.with_ewma(p1(s, d), V, (60,)).select("iso", "quote_date", F.round(dev, 6).alias("deviation_pct"), (dev < 0).alias("truthful"))


@query("direction_5", on_p(f"SELECT iso, quote_date, CASE WHEN v / {Q.lag('v', 5)} - 1 < 0 THEN 'down' ELSE 'up' END AS direction FROM p"))
def _(s, d):
    return p1(s, d).select("iso", "quote_date", F.when(F.col(V) / F.lag(V, 5).over(W.o()) - 1 < 0, "down").otherwise("up").alias("direction"))


@query("disclosure_threshold", on_p(f"SELECT iso, {r('coalesce(quantile_cont(m, 0.5), 50)', 'limit_bps')} FROM (SELECT iso, abs(v / {Q.lag('v')} - 1) * 10000 AS m FROM p) GROUP BY iso"))
def _(s, d):
    return rounded(S.disclosure_threshold(p1(s, d)), "limit_bps", keep=("iso",))

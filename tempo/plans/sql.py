"""DuckDB SQL fragments that the queries' oracles are put together from."""

from __future__ import annotations

RAW = """raw AS (
  SELECT CAST(l_shipdate AS DATE) AS quote_date, l_returnflag || l_returnflag || l_returnflag AS iso, CAST(sum(l_quantity) AS BIGINT) AS nominal,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS rate FROM lineitem GROUP BY 1, 2)"""
P = RAW + """, p AS (SELECT quote_date, CAST(quote_date + 1 AS DATE) AS available_on, iso, nominal, rate, rate / nominal AS v FROM raw)"""
USD = """u AS (SELECT CAST(l_shipdate AS DATE) AS quote_date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS v FROM lineitem GROUP BY 1)"""
O = "PARTITION BY iso ORDER BY quote_date"  # noqa: E741


def over(low: int | str, high: int | str, extra: str = "") -> str:
    side = lambda n: n if isinstance(n, str) else "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"
    return f"OVER ({O}{extra} ROWS BETWEEN {side(low)} AND {side(high)})"


def roll(agg: str, v: str, n: int, k: int) -> str:
    w = over(1 - n, 0)
    return f"CASE WHEN count({v}) {w} >= {k} THEN {agg}({v}) {w} END"


def lag(v: str, n: int = 1) -> str:
    return f"lag({v}, {n}) OVER ({O})"


def ranked(source: str, v: str, n: int, k: int, name: str, keep: str = "*") -> str:
    """A SELECT that adds the average rank of ``v`` among the last ``n`` values."""
    return f"""SELECT {keep} EXCLUDE (_w), CASE WHEN {v} IS NOT NULL AND len(_w) >= {k} THEN
      (len(list_filter(_w, lambda x: x < {v})) + (len(list_filter(_w, lambda x: x = {v})) + 1) / 2.0) / len(_w) END AS {name}
      FROM (SELECT *, list({v}) FILTER ({v} IS NOT NULL) {over(1 - n, 0)} AS _w FROM {source})"""


def ewma(source: str, v: str, span: int, name: str) -> str:
    """A SELECT that adds the exponential mean of ``v`` by folding the values so far."""
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"SELECT *, list_reduce(list({v}) {over('UNBOUNDED PRECEDING', 0)}, lambda y, x: (1 - {a}) * y + {a} * x) AS {name} FROM {source}"


def zscore(source: str, span: int, out: str) -> str:
    """CTEs that end in ``out``: source with m_<span>, z_<span>."""
    return f"""{out}_m AS ({ewma(source, 'v', span, f'm_{span}')}), {out}_d AS (SELECT *, (v - m_{span}) * (v - m_{span}) AS _d FROM {out}_m),
    {out}_s AS ({ewma(f'{out}_d', '_d', span, '_s')}), {out} AS (SELECT * EXCLUDE (_d, _s), (v - m_{span}) / nullif(sqrt(_s), 0) AS z_{span} FROM {out}_s)"""


STREAK = f"""st1 AS (SELECT *, coalesce(CAST(v < {lag('v')} AS INT), 0) AS _dn FROM p),
st2 AS (SELECT *, coalesce(CAST(_dn <> {lag('_dn')} AS INT), 0) AS _ch FROM st1),
st3 AS (SELECT *, sum(_ch) {over('UNBOUNDED PRECEDING', 0)} AS _run FROM st2),
streak AS (SELECT * EXCLUDE (_dn, _ch, _run), CASE WHEN _dn = 1 THEN row_number() OVER (PARTITION BY iso, _run ORDER BY quote_date) ELSE 0 END AS down_streak FROM st3)"""


def week(d: str) -> str:
    return f"strftime(date_trunc('week', {d}), '%Y-%m-%d') || '/' || strftime(date_trunc('week', {d}) + INTERVAL 6 DAY, '%Y-%m-%d')"


def labels(h: int, e: int, source: str = "p", name: str = "lab") -> str:
    """CTEs that end in ``name``: the label columns over ``source``."""
    ahead, around = over(e + 1, e + h), over(e - h, e + h)
    return f"""{name}_w AS (SELECT *, lead(v, {e}) OVER ({O}) AS x, lead(quote_date, {e}) OVER ({O}) AS xd, lead(available_on, {e + h}) OVER ({O}) AS kn,
      count(v) {ahead} AS na, avg(v) {ahead} AS ma, quantile_cont(v, 0.5) {ahead} AS mda, min(v) {ahead} AS mia, max(v) {ahead} AS mxa,
      count(v) {around} AS nc, avg(v) {around} AS mc, min(v) {around} AS mic, avg(1.0::DOUBLE / v) {around} AS bc FROM {source}),
    {name} AS (SELECT * EXCLUDE (x, xd, kn, na, ma, mda, mia, mxa, nc, mc, mic, bc), na = {h} AS ok,
      CASE WHEN na = {h} THEN xd END AS exec_date, CASE WHEN na = {h} THEN x END AS exec_rate, CASE WHEN na = {h} THEN (ma - x) / x * 10000 END AS fwd_advantage_bps,
      CASE WHEN na = {h} THEN (mda - x) / x * 10000 END AS fwd_median_advantage_bps, CASE WHEN na = {h} AND nc = {2 * h + 1} THEN (mc - x) / x * 10000 END AS window_advantage_bps,
      CASE WHEN na = {h} AND nc = {2 * h + 1} THEN ((1.0::DOUBLE / x) / bc - 1.0) * 10000 END AS currency_gain_bps,
      CASE WHEN na = {h} THEN greatest(0.0, -(ma - x) / x * 10000) END AS adverse_bps, CASE WHEN na = {h} THEN greatest(0.0, (x - mia) / x * 10000) END AS regret_bps,
      coalesce(na = {h} AND (ma - x) / x * 10000 < -100, false) AS bad_push, coalesce(na = {h} AND nc = {2 * h + 1} AND mic >= x * (1.0 - 10.0::DOUBLE / 10000), false) AS is_local_min,
      coalesce(na = {h} AND mxa <= x, false) AS held_favourable, coalesce(na = {h} AND mda > x, false) AS held_window_closing, CASE WHEN na = {h} THEN kn END AS label_available_on
      FROM {name}_w)"""


def md5_key(seed: int, *parts: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"

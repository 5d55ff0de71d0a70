"""Column builders over one series' ordered observations, and an ordered scan for recursions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def o() -> WindowSpec:
    """Observations of a series in date order; frames count rows, never calendar days."""
    return Window.partitionBy("iso").orderBy("quote_date")


def last_rows(n: int) -> WindowSpec:
    return o().rowsBetween(1 - n, 0)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def roll(agg: Callable[[Column], Column], v: str | Column, n: int, k: int) -> Column:
    """``agg`` over the last ``n`` rows, null until ``k`` of them hold a value."""
    return F.when(F.count(col(v)).over(last_rows(n)) >= k, agg(col(v)).over(last_rows(n)))


def log_return(v: str | Column, lag: int) -> Column:
    return F.ln(col(v) / F.lag(col(v), lag).over(o()))


def rolling_rank(v: str | Column, n: int, k: int) -> Column:
    """Average rank of today among the last ``n`` values as a share of them; null until ``k`` are there."""
    seen = F.collect_list(col(v)).over(last_rows(n))
    below = F.size(F.filter(seen, lambda x: x < col(v)))
    equal = F.size(F.filter(seen, lambda x: x == col(v)))
    return F.when(col(v).isNotNull() & (F.size(seen) >= k), (below + (equal + 1) / 2) / F.size(seen))


def share_above_today(v: str | Column, n: int, k: int) -> Column:
    """Percent of the ``n - 1`` rows before today that lie strictly above it; null until ``k`` rows with today."""
    seen = F.collect_list(col(v)).over(o().rowsBetween(1 - n, -1))
    return F.when(F.size(seen) + 1 >= k, F.size(F.filter(seen, lambda x: x > col(v))) * 100.0 / F.size(seen))


def with_streak(df: DataFrame, v: str, name: str) -> DataFrame:
    """Adds the length of the run of falls that ends today, 0 on any other day."""
    down = F.coalesce((F.col(v) < F.lag(v).over(o())).cast("int"), F.lit(0))
    flagged = df.withColumn("_down", down)
    change = F.coalesce((F.col("_down") != F.lag("_down").over(o())).cast("int"), F.lit(0))
    runs = flagged.withColumn("_change", change).withColumn("_run", F.sum("_change").over(o()))
    place = F.row_number().over(Window.partitionBy("iso", "_run").orderBy("quote_date"))
    return runs.withColumn(name, F.when(F.col("_down") == 1, place).otherwise(0)).drop("_down", "_change", "_run")


def one_row_each(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows; a plan that reads them fails once it meets ``keys`` twice, as a join that must not multiply rows needs it.

    Rows with equal keys are neighbours in the order by the other keys within the first, which the windows over a series
    share, so the check costs no job and no shuffle of its own.
    """
    first, *rest = keys
    told = F.concat(F.lit(f"{name} has more than one row for "), F.to_json(F.struct(*keys)))
    again = F.lag(F.struct(*rest)).over(Window.partitionBy(first).orderBy(*rest)).eqNullSafe(F.struct(*rest))
    return rows.withColumn("_again", again).filter(F.when(F.col("_again"), F.raise_error(told).cast("boolean")).otherwise(F.lit(True))).drop("_again")


def window_id(date: str | Column, window: str) -> Column:
    """``YYYY-MM-DD/YYYY-MM-DD`` from Monday to Sunday, or ``YYYY-MM``."""
    if window == "month":
        return F.date_format(col(date), "yyyy-MM")
    monday = F.to_date(F.date_trunc("week", col(date)))
    return F.concat_ws("/", F.date_format(monday, "yyyy-MM-dd"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd"))


def ordered_scan(df: DataFrame, fields: list[tuple[str, str]], start: Callable[[], object], step: Callable) -> DataFrame:
    """Adds columns by a recursion along each series.

    ``step(state, frame) -> columns`` sees consecutive rows of one series and may change ``state`` (from ``start()``).
    Series are dealt over tasks and streamed batch by batch in date order, so memory does not grow with their length.
    """
    schema = T.StructType([f for f in df.schema.fields if f.name not in {n for n, _ in fields}])
    names = schema.fieldNames()
    for name, kind in fields:
        schema = schema.add(name, T.DataType.fromDDL(kind))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            parts = []
            for iso, part in batch.groupby("iso", sort=False):
                if iso != current:
                    current, state = iso, start()
                parts.append(part.assign(**step(state, part)))
            if parts:
                yield pd.concat(parts)[schema.fieldNames()]

    return df.select(*names).repartition("iso").sortWithinPartitions("iso", "quote_date").mapInPandas(run, schema)


def with_ewma(df: DataFrame, v: str, spans: tuple[int, ...]) -> DataFrame:
    """Adds mean_<span> and var_<span>: y = (1 - a) y + a x with a = 2 / (span + 1), and the same of (x - mean)^2."""

    def smooth(carry: float | None, x: pd.Series, span: int) -> pd.Series:
        if carry is None:
            return x.ewm(span=span, adjust=False).mean()
        return pd.concat([pd.Series([carry]), x]).ewm(span=span, adjust=False).mean().iloc[1:]

    def step(state: dict, part: pd.DataFrame) -> dict:
        x, out = part[v].astype(float), {}
        for span in spans:
            mean = smooth(state.get(("m", span)), x, span)
            var = smooth(state.get(("v", span)), (x - mean) ** 2, span)
            state["m", span], state["v", span] = mean.iloc[-1], var.iloc[-1]
            out |= {f"mean_{span}": mean.to_numpy(), f"var_{span}": var.to_numpy()}
        return out

    return ordered_scan(df, [(f"{n}_{s}", "double") for s in spans for n in ("mean", "var")], dict, step)


def with_own_ewma(df: DataFrame, v: str, span: str, name: str) -> DataFrame:
    """Adds ``name``: the exponential mean of ``v`` over the span that each series' rows carry in the column ``span``."""

    def step(state: dict, part: pd.DataFrame) -> dict:
        x, n = part[v].astype(float), float(part[span].iloc[0])
        known = pd.concat([pd.Series([state["mean"]]), x]) if "mean" in state else x
        mean = known.ewm(span=n, adjust=False).mean().iloc[len(known) - len(x) :]
        state["mean"] = mean.iloc[-1]
        return {name: mean.to_numpy()}

    return ordered_scan(df, [(name, "double")], dict, step)


def ew_zscore(v: str, span: int) -> Column:
    """Distance from the exponential mean in exponential deviations; null where there is no deviation."""
    return (F.col(v) - F.col(f"mean_{span}")) / F.nullif(F.sqrt(F.col(f"var_{span}")), F.lit(0.0))

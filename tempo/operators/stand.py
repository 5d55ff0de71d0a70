"""The day-by-day stand: its corridors, drawn series, one decision a calendar day, stored for point lookups, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempo.functions.storage import cut_lineage
from tempo.functions.windows import o, with_own_ewma
from tempo.operators.benchmark import prefixes
from tempo.operators.indicators import next_on_or_after
from tempo.operators.signals import SignalConfig, signal_table
from tempo.operators.stats import draw_key
from tempo.sources.panel import with_names

V = "rub_per_unit"
USUAL_SPAN, USUAL_MOVE = 10, 50.0  # fixed values: where a series has no signal, or no move


def since(rows: DataFrame, start: str, date: str = "quote_date") -> DataFrame:
    return rows.filter(F.col(date) >= F.lit(start).cast("date"))


def span_of(window: Column) -> Column:
    return F.try_element_at(F.split(window, "="), F.lit(2)).try_cast("int")


def daily_moves(panel: DataFrame, start: str) -> DataFrame:
    """Absolute moves in bps from one drawn quote to the next; the first drawn quote has none."""
    return since(panel, start).withColumn("move_bps", F.abs(F.col(V) / F.lag(V).over(o()) - 1) * 10_000)


def corridors(panel: DataFrame, signals: DataFrame, start: str, sim_start: str) -> DataFrame:
    """One row per series with quotes from ``start`` on: names, dates, the size of an ordinary day, the usual trend span.

    The usual span is the one that most drawn signals name, the first one seen on ties.
    """
    drawn = daily_moves(panel, start).groupBy("iso").agg(F.min("quote_date").alias("first_date"), F.max("quote_date").alias("last_date"), F.round(F.coalesce(F.expr("percentile(move_bps, 0.5)"), F.lit(USUAL_MOVE)), 1).alias("threshold_bps"))
    named = since(signals, start, "signal_date").withColumn("span", span_of(F.col("window"))).filter("span is not null")
    counted = named.groupBy("iso", "span").agg(F.count(F.lit(1)).alias("n"), F.min("signal_date").alias("first"))
    usual = counted.groupBy("iso").agg(F.min_by("span", F.struct(-F.col("n"), "first")).alias("trend_span"))
    out = with_names(drawn.join(usual, "iso", "left")).withColumns({"trend_span": F.coalesce("trend_span", F.lit(USUAL_SPAN)), "sim_start": F.lit(sim_start).cast("date")})
    return out.select("iso", F.col("currency_name").alias("name"), "country", "first_date", "last_date", "sim_start", "threshold_bps", "trend_span")


def trend_series(panel: DataFrame, listed: DataFrame, start: str) -> DataFrame:
    """iso, quote_date, rate, trend of the drawn quotes; each series' trend has its own span and its whole history behind it."""
    own = panel.join(listed.select("iso", "trend_span"), "iso")
    done = with_own_ewma(own.select("iso", "quote_date", V, "trend_span"), V, "trend_span", "trend")
    return since(done, start).select("iso", "quote_date", F.round(V, 6).alias("rate"), F.round("trend", 6).alias("trend"))


def client_message() -> Column:
    """The message with the currency's name in place of its code, once."""
    at = F.instr("message", F.col("iso"))
    before, after = F.substring("message", F.lit(1), at - 1), F.substr(F.col("message"), at + F.length("iso"))
    return F.when(at > 0, F.concat(before, F.col("currency_name"), after)).otherwise(F.col("message"))


def shown_signals(signals: DataFrame, start: str) -> DataFrame:
    """Drawn signals as the stand shows them: rounded, and with the currency's name in place of its code in the message."""
    rows = with_names(since(signals, start, "signal_date"))
    return rows.select(
        "iso", "signal_date", "indicator", F.round(V, 6).alias("rate"), F.round("deviation_pct", 3).alias("deviation_pct"), F.coalesce(span_of(F.col("window")), F.lit(0)).alias("span"), "speed", "scenario", "direction",
        F.round("strength_pct", 4).alias("strength_pct"), "message", client_message().alias("client_message"),
    )


def day_log(panel: DataFrame, signals: DataFrame, start: str) -> DataFrame:
    """iso, day, has_quote, rate, decision, signal for every calendar day of the drawn range: ``hold`` without a signal.

    Days without a quote are holds too: nothing new was published.
    """
    drawn = since(panel, start).select("iso", F.col("quote_date").alias("day"), F.round(V, 6).alias("rate"))
    span = drawn.groupBy("iso").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    sent = shown_signals(signals, start)
    sent = sent.select("iso", F.col("signal_date").alias("day"), F.struct(*[c for c in sent.columns if c != "iso"]).alias("signal"))
    out = span.join(drawn, ["iso", "day"], "left").join(sent, ["iso", "day"], "left")
    return out.select("iso", "day", F.col("rate").isNotNull().alias("has_quote"), "rate", F.when(F.col("signal").isNotNull(), "candidate").otherwise("hold").alias("decision"), "signal")


def store_days(days: DataFrame, path: str) -> None:
    """The day log as Parquet in the order of series and day, so that a lookup reads the one row group that may hold it."""
    days.repartitionByRange("iso", "day").sortWithinPartitions("iso", "day").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(path)


def look_up(spark: SparkSession, path: str, iso: str, day: str) -> DataFrame:
    """One row: the stored decision of a day, or a hold without a quote where none is stored."""
    code = iso.strip().upper()
    stored = spark.read.parquet(path).filter((F.col("iso") == code) & (F.col("day") == F.lit(day).cast("date")))
    asked = spark.range(1).select(F.lit(code).alias("iso"), F.lit(day).cast("date").alias("day"))
    found = asked.join(stored, ["iso", "day"], "left")
    return found.withColumns({"has_quote": F.coalesce("has_quote", F.lit(False)), "decision": F.coalesce("decision", F.lit("hold"))})


# Exports: nested pieces, each bounded by a month of one series


def _pieces(rows: DataFrame, date: str, kind: str, fields: list[Column]) -> DataFrame:
    """iso, kind, month, payload: one JSON array per series and month, in date order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(date).alias("_at"), F.struct(*fields).alias("item"))))
    told = rows.groupBy("iso", F.date_format(date, "yyyy-MM").alias("month")).agg(items.alias("items"))
    return told.select("iso", F.lit(kind).alias("kind"), "month", F.to_json(F.transform("items", lambda x: x["item"])).alias("payload"))


def with_following(panel: DataFrame, n: int = 5, ahead: int = 10) -> DataFrame:
    """Each quote with up to ``n`` following ones (d, r, bps from it) and the mean of up to ``ahead`` in bps from it."""
    steps = F.array_compact(F.array(*[
        F.when(F.lead(V, i).over(o()).isNotNull(), F.struct(F.date_format(F.lead("quote_date", i).over(o()), "yyyy-MM-dd").alias("d"), F.round(F.lead(V, i).over(o()), 6).alias("r"), F.round((F.lead(V, i).over(o()) / F.col(V) - 1) * 10_000, 1).alias("bps")))
        for i in range(1, n + 1)
    ]))
    mean = F.avg(V).over(o().rowsBetween(1, ahead))
    return panel.select("iso", F.col("quote_date").alias("signal_date"), steps.alias("follow"), F.round((mean / F.col(V) - 1) * 10_000, 1).alias("forward_bps"))


def statistics(panel: DataFrame, signals: DataFrame, start: str) -> DataFrame:
    """Per series: drawn signals, signals a week of the drawn range, median and 90 % daily move, last rate and date."""
    drawn = daily_moves(panel, start).groupBy("iso").agg(
        (F.date_diff(F.max("quote_date"), F.min("quote_date")) / 7).alias("_weeks"), F.round(F.expr("percentile(move_bps, 0.5)"), 1).alias("median_move_bps"), F.round(F.expr("percentile(move_bps, 0.9D)"), 1).alias("p90_move_bps"),
        F.round(F.max_by(V, "quote_date"), 6).alias("last_rate"), F.max("quote_date").alias("last_date"),
    )
    n = since(signals, start, "signal_date").groupBy("iso").agg(F.count(F.lit(1)).alias("n_signals"))
    out = drawn.join(n, "iso", "left").withColumn("n_signals", F.coalesce("n_signals", F.lit(0).cast("long")))
    return out.withColumn("per_week", F.round(F.try_divide("n_signals", "_weeks"), 2)).select("iso", "n_signals", "per_week", "median_move_bps", "p90_move_bps", "last_rate", "last_date")


def signal_audit(panel: DataFrame, signals: DataFrame, days: list[str], start: str, config: SignalConfig = SignalConfig()) -> DataFrame:
    """asof, iso, n, identical, fired_today: the signals of the panel cut at each of a few days against those it has in full.

    All cuts are series of one plan; quotes after a cut are deleted.
    """
    cuts = panel.select("iso").distinct().withColumn("cut", F.explode(F.array(*[F.lit(d).cast("date") for d in days])))
    cut_off = since(signal_table(prefixes(panel, cuts), config), start, "signal_date")
    then = cut_off.select(F.substring_index("iso", "@", 1).alias("iso"), F.substring_index("iso", "@", -1).cast("date").alias("cut"), "signal_date", F.lit(1).alias("a"))
    full = since(signals, start, "signal_date").select("iso", "signal_date").join(cuts, "iso").filter("signal_date <= cut").withColumn("b", F.lit(1))
    both = cuts.join(then.join(full, ["iso", "cut", "signal_date"], "full"), ["iso", "cut"], "left")
    return both.groupBy(F.col("cut").alias("asof"), "iso").agg(
        F.count("a").alias("n"), (F.count_if(F.col("signal_date").isNotNull() & (F.col("a").isNull() | F.col("b").isNull())) == 0).alias("identical"), F.coalesce(F.bool_or((F.col("signal_date") == F.col("cut")) & F.col("a").isNotNull()), F.lit(False)).alias("fired_today")
    )


def export_pieces(panel: DataFrame, signals: DataFrame, start: str, sim_start: str, audited: list[str]) -> DataFrame:
    """iso, kind, month, payload (JSON): series and signals by month, statistics and audit by series, meta of all.

    No row holds more than a month of a series, or one number of an audit a day asked for.
    """
    listed = cut_lineage(corridors(panel, signals, start, sim_start))
    series = _pieces(trend_series(panel, listed, start), "quote_date", "series", [F.date_format("quote_date", "yyyy-MM-dd").alias("d"), F.col("rate").alias("r"), F.col("trend").alias("e")])
    facts = shown_signals(signals, start).join(signals.select("iso", "signal_date", "window", F.round("level_percentile", 1).alias("level_percentile")), ["iso", "signal_date"])
    told = facts.join(with_following(panel), ["iso", "signal_date"])
    fields = ["rate", "follow", "forward_bps", "deviation_pct", "window", "span", "speed", "strength_pct", "level_percentile", "scenario", "direction", "message"]
    sent = _pieces(told, "signal_date", "signals", [F.date_format("signal_date", "yyyy-MM-dd").alias("date"), *[F.col(c) for c in fields]])
    one = lambda rows, kind, item: rows.select("iso", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("month"), F.to_json(item).alias("payload"))
    stats = one(statistics(panel, signals, start).join(listed.select("iso", "name", "country"), "iso"), "stats", F.struct("name", "country", "n_signals", "per_week", "median_move_bps", "p90_move_bps", "last_rate", F.date_format("last_date", "yyyy-MM-dd").alias("last_date")))
    audit = cut_lineage(signal_audit(panel, signals, audited, start))
    checks = one(audit.groupBy("iso").agg(F.array_sort(F.collect_list(F.struct(F.date_format("asof", "yyyy-MM-dd").alias("asof"), "n", "identical", "fired_today"))).alias("rows")), "audit", F.col("rows"))
    meta = panel.agg(F.date_format(F.min("quote_date"), "yyyy-MM-dd").alias("panel_from"), F.date_format(F.max("quote_date"), "yyyy-MM-dd").alias("panel_to"), F.count(F.lit(1)).alias("observations")).withColumn("iso", F.lit(None).cast("string"))
    about = one(meta, "meta", F.struct("panel_from", "panel_to", "observations", F.lit(start).alias("window_from")))
    return series.unionByName(sent).unionByName(stats).unionByName(checks).unionByName(about)


PAYLOADS = {
    "series": "array<struct<d: date, r: double, e: double>>",
    "signals": "array<struct<date: date, rate: double, follow: array<struct<d: date, r: double, bps: double>>, forward_bps: double, deviation_pct: double, window: string, span: int, speed: string, strength_pct: double, level_percentile: double, scenario: string, direction: string, message: string>>",
    "stats": "struct<name: string, country: string, n_signals: long, per_week: double, median_move_bps: double, p90_move_bps: double, last_rate: double, last_date: date>",
    "audit": "array<struct<asof: date, n: long, identical: boolean, fired_today: boolean>>",
    "meta": "struct<panel_from: date, panel_to: date, observations: long, window_from: date>",
}


def write_export(pieces: DataFrame, path: str) -> None:
    """JSON lines in a folder per kind."""
    pieces.repartition("kind", "iso").write.mode("overwrite").partitionBy("kind").json(path)


def read_export(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The items of one kind, a row each, with typed columns and their series."""
    read = spark.read.schema("iso string, kind string, month string, payload string").json(path).filter(F.col("kind") == kind)
    item = F.from_json("payload", PAYLOADS[kind])
    rows = read.select("iso", F.explode(item).alias("x")) if PAYLOADS[kind].startswith("array") else read.select("iso", item.alias("x"))
    return rows.select("iso", "x.*")


# The trailing year as a page shows it


def corridor_bundle(panel: DataFrame, events: DataFrame, months: int = 12, seed: int = 0) -> DataFrame:
    """iso, quote_date, rate, model, regular, random: each drawn quote and which of three ways of buying buys on it.

    A signal buys on its day or the next quote; the regular way on every fifth quote; the random way, one draw, on as
    many days as the signals.
    """
    last = panel.agg(F.add_months(F.max("quote_date"), -months).alias("begin"))
    days = panel.crossJoin(last).filter("quote_date >= begin").drop("begin").select("iso", "quote_date", V)  # one row of bounds
    sent = events.crossJoin(last).filter("signal_date >= begin").select("iso", "signal_date")
    on = next_on_or_after(sent, days.select("iso", F.col("quote_date").alias("mark_date")), strict=False).filter("mark_date is not null")
    bought = on.select("iso", F.col("mark_date").alias("quote_date"), F.lit(True).alias("model")).distinct()
    n = sent.groupBy("iso").agg(F.count(F.lit(1)).alias("_n"))
    drawn = F.row_number().over(Window.partitionBy("iso").orderBy(draw_key(seed, F.lit(0), "iso", "quote_date")))
    marked = days.join(n, "iso", "left").withColumns({"_at": F.row_number().over(o()) - 1, "_drawn": drawn, "_days": F.count(F.lit(1)).over(Window.partitionBy("iso"))})
    out = marked.join(bought, ["iso", "quote_date"], "left")
    chosen = F.coalesce((F.col("_days") > F.col("_n")) & (F.col("_drawn") <= F.col("_n")), F.lit(False))
    return out.select("iso", "quote_date", F.col(V).alias("rate"), F.coalesce("model", F.lit(False)).alias("model"), (F.col("_at") % 5 == 0).alias("regular"), chosen.alias("random"))

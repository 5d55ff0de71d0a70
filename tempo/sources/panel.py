"""Quote files, validation and the canonical panel: quote_date, available_on, iso, nominal, rate, rub_per_unit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempo.functions.windows import o

REQUIRED = ("date", "iso", "nominal", "rate")
PANEL = ("quote_date", "available_on", "iso", "nominal", "rate", "rub_per_unit")
BREAK_RATIO = 10.0
NAMES = {"TJS": ("сомони", "Таджикистан"), "UZS": ("сум", "Узбекистан"), "KGS": ("сом", "Кыргызстан"), "AMD": ("драм", "Армения"), "KZT": ("тенге", "Казахстан")}  # fixed values: currency, country
CHUNK_DAYS = 366


class RateDataError(ValueError):
    """Quotes that break the panel's contract."""


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def parsed_day(text: Column) -> Column:
    """The day that a text names: ISO with or without a time of day, dd/MM/yyyy or dd.MM.yyyy; null for anything else.

    A time zone is dropped, not applied, so the day does not depend on the session's.
    """
    plain = F.regexp_replace(F.trim(text.cast("string")), r"^(.*[0-9]:[0-9]{2}(?:[.][0-9]+)?)\s*(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)$", "$1")
    iso = F.to_date(plain.try_cast("timestamp_ntz"))
    other = [F.when(plain.rlike(f"^[0-9]{{2}}{sep}[0-9]{{2}}{sep}[0-9]{{4}}$"), F.concat_ws("-", F.substring(plain, 7, 4), F.substring(plain, 4, 2), F.substring(plain, 1, 2)).try_cast("date")) for sep in ("/", "[.]")]
    return F.coalesce(iso, *other)


def coerced(frame: DataFrame) -> DataFrame:
    """Raw quotes with typed columns; what can't be read is null. rate_per_unit is kept where given."""
    if missing := [c for c in REQUIRED if c not in frame.columns]:
        raise RateDataError(f"Missing required columns: {missing}")
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    given = number("rate_per_unit") if "rate_per_unit" in frame.columns else F.lit(None).cast("double")
    return frame.select(
        parsed_day(F.col("date")).alias("quote_date"),
        F.upper(F.trim(F.col("iso").cast("string"))).alias("iso"),
        number("nominal").alias("nominal"),
        number("rate").alias("rate"),
        given.alias("rate_per_unit"),
    )


def violations(frame: DataFrame) -> DataFrame:
    """One row with the number of quotes that break each rule; ``frame`` is ``coerced``."""
    n, r, u = F.col("nominal"), F.col("rate"), F.col("rate_per_unit")
    whole, unit = F.round(n), F.try_divide(r, n)
    bad = {
        "bad_date": F.col("quote_date").isNull(),
        "bad_iso": ~F.coalesce(F.col("iso").rlike("^[A-Z]{3}$"), F.lit(False)),
        "bad_nominal": ~_finite(n) | (n <= 0),
        "bad_rate": ~_finite(r) | (r <= 0),
        "not_whole": _finite(n) & (F.abs(n - whole) > 1e-8 + 1e-5 * F.abs(whole)),
        "bad_unit_rate": u.isNotNull() & (F.abs(u - unit) > 1e-12 + 1e-10 * F.abs(unit)),
    }
    marked = frame.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("quote_date", "iso")))
    return marked.agg(*[F.count_if(c).alias(k) for k, c in bad.items()], F.count_if(F.col("copies") > 1).alias("duplicates"))


def panel_of(frame: DataFrame, availability_lag_days: int = 1) -> DataFrame:
    """The canonical panel of ``coerced`` quotes, unchecked and lazy."""
    if availability_lag_days < 0:
        raise RateDataError("availability_lag_days must not be negative")
    return frame.select(
        "quote_date",
        F.date_add("quote_date", availability_lag_days).alias("available_on"),
        "iso",
        F.round("nominal").cast("long").alias("nominal"),
        "rate",
        F.try_divide("rate", "nominal").alias("rub_per_unit"),
    )


def normalize(frame: DataFrame, availability_lag_days: int = 1) -> DataFrame:
    """The canonical panel; raises RateDataError naming the rules that quotes break (one aggregate runs)."""
    read = coerced(frame)
    names = {"duplicates": "Duplicate (date, iso)", "bad_unit_rate": "rate_per_unit does not match rate / nominal", "not_whole": "nominal is not whole"}
    found = violations(read).first().asDict()
    if broken := [f"{names.get(k, k)}: {v} rows" for k, v in found.items() if v]:
        raise RateDataError("; ".join(broken))
    return panel_of(read, availability_lag_days)


def read_rate_csv(spark: SparkSession, path: str, availability_lag_days: int = 1) -> DataFrame:
    """The canonical panel of one quote file; columns are found by their names."""
    return normalize(spark.read.option("header", True).option("nullValue", "").csv(path), availability_lag_days)


def _quote_files(spark: SparkSession, directory: str) -> DataFrame:
    """path, iso of the files that are named ``rates_<ISO>.csv`` or lie in a folder ``iso=<ISO>``, as ``write_rates`` leaves them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(directory)
    named, foldered = F.regexp_extract("path", r"/rates_([A-Za-z]{3})\.csv$", 1), F.regexp_extract("path", r"/iso=([A-Za-z]{3})/[^/]+$", 1)
    return files.select("path", F.upper(F.concat(named, foldered)).alias("iso"), F.regexp_extract(F.decode("content", "UTF-8"), r"^[^\r\n]*", 0).alias("header")).filter("iso <> ''")


def read_rate_directory(spark: SparkSession, directory: str, currencies: Sequence[str] | None = None, availability_lag_days: int = 1) -> DataFrame:
    """All quote files of a folder, or only those of the currencies asked for: no quote of others is read.

    Files may order their columns differently and lack optional ones: files with equal headers are read together, then
    united by column names. A currency has one file or a few, so their list is short.
    """
    found = _quote_files(spark, directory)
    if currencies is not None:
        found = found.filter(F.col("iso").isin([c.strip().upper() for c in currencies]))
    listed = found.collect()
    if not listed:
        raise RateDataError("None of the requested currencies has a source file" if currencies is not None else f"No quote files in {directory}")
    by_header: dict[str, list[str]] = {}
    for r in listed:
        by_header.setdefault(r["header"], []).append(r["path"])
    frames = [spark.read.option("header", True).option("nullValue", "").csv(sorted(paths)).withColumn("_path", F.col("_metadata.file_path")) for _, paths in sorted(by_header.items())]
    frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    named = F.upper(F.regexp_extract("_path", r"/(?:rates_|iso=)([A-Za-z]{3})(?:\.csv$|/)", 1))
    frame = frame.withColumn("_file", named).drop("_path")
    if "iso" not in frame.columns:
        frame = frame.withColumn("iso", F.col("_file"))
    strays = frame.filter(F.upper(F.trim(F.coalesce("iso", "_file"))) != F.col("_file")).limit(1).count()
    if strays:
        raise RateDataError("A file holds quotes of another currency than its name says")
    return normalize(frame.withColumn("iso", F.coalesce("iso", "_file")).drop("_file"), availability_lag_days)


def parse_rate_xml(documents: DataFrame) -> DataFrame:
    """``documents`` (iso, xml) of daily records -> raw quotes: one row per record, whatever it leaves blank.

    Numbers have decimal commas. A blank nominal counts as 1 in the unit rate, which is the record's own where given.
    """
    record = "array<struct<_Date: string, Nominal: string, Value: string, VunitRate: string>>"
    number = lambda c: F.expr(f"try_cast(replace(replace(nullif(trim({c}), ''), ' ', ''), ',', '.') AS double)")
    rows = documents.select("iso", F.explode(F.from_xml("xml", f"Record {record}").getField("Record")).alias("r"))
    quotes = rows.select(F.to_date("r._Date", "dd.MM.yyyy").alias("date"), "iso", number("r.Nominal").alias("nominal"), number("r.Value").alias("rate"), number("r.VunitRate").alias("given"))
    unit = F.coalesce("given", F.try_divide("rate", F.coalesce(F.nullif("nominal", F.lit(0.0)), F.lit(1.0))))
    return quotes.select("date", "iso", "nominal", "rate", unit.alias("rate_per_unit"))


def request_chunks(spark: SparkSession, start: str, end: str, days: int = CHUNK_DAYS) -> DataFrame:
    """Date ranges of at most ``days`` days that cover start..end, for sources that limit a request."""
    one = spark.range(1).select(F.lit(start).cast("date").alias("s"), F.lit(end).cast("date").alias("e"))
    begun = one.select("e", F.explode(F.expr(f"sequence(s, e, interval {days} day)")).alias("chunk_start"))
    return begun.select("chunk_start", F.least(F.date_add("chunk_start", days - 1), F.col("e")).alias("chunk_end"))


def first_quotes(raw: DataFrame, order: str) -> DataFrame:
    """One quote per (date, iso): the first by ``order``."""
    first = F.row_number().over(Window.partitionBy("date", "iso").orderBy(order))
    return raw.withColumn("_n", first).filter("_n = 1").drop("_n")


def series_breaks(panel: DataFrame, ratio: float = BREAK_RATIO) -> DataFrame:
    """Quotes more than ``ratio`` times above or below the one before: redenominations."""
    rel = F.col("rub_per_unit") / F.lag("rub_per_unit").over(o())
    return panel.withColumn("rel", rel).filter((F.col("rel") > ratio) | (F.col("rel") < 1 / ratio))


def after_last_break(panel: DataFrame, ratio: float = BREAK_RATIO) -> DataFrame:
    """Only what follows each series' last break, the break itself left out."""
    rel = F.col("rub_per_unit") / F.lag("rub_per_unit").over(o())
    marked = panel.withColumn("_break", F.when((rel > ratio) | (rel < 1 / ratio), F.col("quote_date")))
    last = F.max("_break").over(Window.partitionBy("iso"))
    return marked.withColumn("_last", last).filter("_last is null or quote_date > _last").drop("_break", "_last")


def as_of(panel: DataFrame, date: str | Column) -> DataFrame:
    """Rows that may be used on a date."""
    return panel.filter(F.col("available_on") <= (F.lit(date).cast("date") if isinstance(date, str) else date))


def latest_quotes(panel: DataFrame, date: str | Column) -> DataFrame:
    """Each series' last usable quote on a date."""
    row = F.max_by(F.struct(*[c for c in panel.columns if c != "iso"]), "quote_date")
    return as_of(panel, date).groupBy("iso").agg(row.alias("r")).select("iso", "r.*")


def with_names(rows: DataFrame) -> DataFrame:
    """Adds currency_name and country of ``iso``; the code itself and an empty string where there is none."""
    name = F.element_at(F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, v[0])]), F.col("iso"))
    country = F.element_at(F.create_map(*[F.lit(x) for k, v in NAMES.items() for x in (k, v[1])]), F.col("iso"))
    return rows.withColumns({"currency_name": F.coalesce(name, "iso"), "country": F.coalesce(country, F.lit(""))})


def unknown_sources(panel: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The series asked for without a quote: a service with any is degraded."""
    asked = panel.sparkSession.createDataFrame([(w.strip().upper(),) for w in wanted], "iso string")
    return asked.join(panel.select("iso").distinct(), "iso", "left_anti")


def between(rows: DataFrame, start: str | Column | None = None, end: str | Column | None = None, date: str = "quote_date") -> DataFrame:
    """Rows dated from ``start`` to ``end``, both inclusive; an open side is None."""
    for bound, inside in ((start, lambda d: F.col(date) >= d), (end, lambda d: F.col(date) <= d)):
        if bound is not None:
            rows = rows.filter(inside(F.lit(bound).cast("date") if isinstance(bound, str) else bound))
    return rows


def readiness(panel: DataFrame) -> DataFrame:
    """How many quotes there are per series and until when."""
    return panel.groupBy("iso").agg(F.count(F.lit(1)).alias("n_quotes"), F.max("available_on").alias("available_until"))


# Panels derived from the star schema, for use where no quote files are at hand

def shipment_quotes(lineitem: DataFrame) -> DataFrame:
    """Raw quotes per return flag and ship date: the price of all shipped units, and their number as nominal."""
    iso = F.concat("l_returnflag", "l_returnflag", "l_returnflag")
    day = lineitem.groupBy(F.to_date("l_shipdate").alias("date"), iso.alias("iso"))
    return day.agg(F.sum("l_quantity").cast("long").alias("nominal"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("rate"))


def shipment_panel(lineitem: DataFrame) -> DataFrame:
    return panel_of(coerced(shipment_quotes(lineitem)))


def context_panel(lineitem: DataFrame) -> DataFrame:
    """The same over all flags, as the USD series."""
    return shipment_panel(lineitem.withColumn("l_returnflag", F.lit("U"))).withColumn("iso", F.lit("USD"))


def order_panel(orders: DataFrame) -> DataFrame:
    """Average order price per priority and day: five series."""
    iso = F.element_at(F.create_map(*[F.lit(x) for x in ("1", "URG", "2", "HIG", "3", "MED", "4", "NOT", "5", "LOW")]), F.substring("o_orderpriority", 1, 1))
    day = orders.groupBy(F.to_date("o_orderdate").alias("date"), iso.alias("iso"))
    quotes = day.agg(F.count(F.lit(1)).alias("nominal"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("rate"))
    return panel_of(coerced(quotes))


def hourly_events(events: DataFrame) -> DataFrame:
    """Mean value and number of events per type and hour."""
    hour = events.groupBy(F.col("event_type").alias("iso"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("quote_hour"))
    return hour.agg(F.count(F.lit(1)).alias("nominal"), F.avg("value").alias("rub_per_unit"))

"""Quotes from a source that answers one series and a limited range of dates per request, as a Spark data source.

Every (series, range of dates) is one partition, so requests run side by side, a failed one is tried again where it runs,
and a lost executor costs its own ranges. How a range is fetched is given by the caller: no address is built in.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tempo.sources.panel import CHUNK_DAYS, PANEL, after_last_break, coerced, first_quotes, panel_of, parse_rate_xml, series_breaks

SCHEMA = "iso string, chunk_start date, chunk_end date, xml string"


class Chunk(InputPartition):
    def __init__(self, iso: str, start: dt.date, end: dt.date):
        self.iso, self.start, self.end = iso, start, end


def fetched(fetch: Callable[[str, dt.date, dt.date], str], chunk: Chunk, retries: int, backoff: float) -> str:
    """What ``fetch`` answers; a failure is tried again after backoff, twice backoff and so on, ``retries`` times in all."""
    for turn in range(retries):
        try:
            return fetch(chunk.iso, chunk.start, chunk.end)
        except Exception as failure:  # whatever a network may raise
            if turn + 1 == retries:
                raise RuntimeError(f"{chunk.iso} from {chunk.start} to {chunk.end} was not answered in {retries} tries: {failure}") from failure
            time.sleep(backoff * 2**turn)
    raise ValueError("retries must be positive")


def chunk_source(fetch: Callable[[str, dt.date, dt.date], str], name: str = "rate_chunks") -> type[DataSource]:
    """A data source around ``fetch(iso, first day, last day) -> XML``; register it with ``spark.dataSource.register``.

    Options: isos (comma-separated), start, end, days (of one request), retries, backoff (seconds).
    """

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.isos = [i.strip().upper() for i in options["isos"].split(",") if i.strip()]
            self.start, self.end = dt.date.fromisoformat(options["start"]), dt.date.fromisoformat(options["end"])
            self.days, self.retries, self.backoff = int(options.get("days", CHUNK_DAYS)), int(options.get("retries", 3)), float(options.get("backoff", 1.0))
            if self.end < self.start or self.days < 1 or self.retries < 1:
                raise ValueError("end must not lie before start, days and retries must be positive")

        def partitions(self) -> list[Chunk]:
            begins = range(0, (self.end - self.start).days + 1, self.days)
            day = lambda n: self.start + dt.timedelta(days=n)
            return [Chunk(iso, day(n), min(day(n + self.days - 1), self.end)) for iso in self.isos for n in begins]

        def read(self, chunk: Chunk) -> Iterator[tuple]:
            yield chunk.iso, chunk.start, chunk.end, fetched(fetch, chunk, self.retries, self.backoff)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    return Source


def collect_quotes(spark: SparkSession, fetch: Callable[[str, dt.date, dt.date], str], isos: Sequence[str], start: str, end: str, trim: bool = True, lag_days: int = 1, **options: object) -> tuple[DataFrame, DataFrame]:
    """(panel, breaks) of all series from ``start`` to ``end``: the first quote of a day, what follows the last break.

    ``breaks`` are the days on which a series jumps tenfold; with ``trim`` off the panel keeps what came before them.
    """
    spark.dataSource.register(chunk_source(fetch))
    given = {"isos": ",".join(isos), "start": start, "end": end} | {k: str(v) for k, v in options.items()}
    documents = spark.read.format("rate_chunks").options(**given).load()
    raw = first_quotes(parse_rate_xml(documents), "rate_per_unit").filter("rate is not null")
    panel = panel_of(coerced(raw), lag_days)
    return (after_last_break(panel).select(*PANEL) if trim else panel), series_breaks(panel).select("iso", "quote_date", "rel")

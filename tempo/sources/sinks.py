"""Writers for panels, logs and result tables."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_rates(panel: DataFrame, path: str) -> None:
    """Quotes as CSV with a header in one folder ``iso=<ISO>`` per currency, which ``read_rate_directory`` reads back."""
    quotes = panel.select(F.col("quote_date").alias("date"), "iso", "nominal", "rate", F.col("rub_per_unit").alias("rate_per_unit"))
    quotes.repartition("iso").write.mode("overwrite").partitionBy("iso").option("header", True).csv(path)


def write_log(decisions: DataFrame, path: str) -> None:
    """JSON lines, dates in ISO form."""
    decisions.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").json(path)


def finite(c: str | Column) -> Column:
    """The number, or null where JSON has none for it."""
    v = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def write_backtest(decisions: DataFrame, drawn: DataFrame, report: DataFrame, path: str) -> None:
    """A backtest's decision log, the days that its random schedules drew, and its summary, each as JSON lines."""
    write_log(decisions, f"{path.rstrip('/')}/decision_log")
    write_log(drawn, f"{path.rstrip('/')}/random_baseline")
    numbers = [f.name for f in report.schema.fields if f.dataType.typeName() == "double"]
    write_log(report.withColumns({c: finite(c) for c in numbers}), f"{path.rstrip('/')}/summary")


def _schema_path(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/_schemas/{name}"


def write_artefacts(tables: Mapping[str, DataFrame], path: str, kind: str = "csv") -> list[str]:
    """Each table under its name, its schema beside it; empty ones are left out. Returns the names written."""
    written = []
    for name, table in tables.items():
        if not table.isEmpty():
            writer = table.write.mode("overwrite")
            (writer.option("header", True) if kind == "csv" else writer).format(kind).save(f"{path.rstrip('/')}/{name}")
            told = json.dumps({"kind": kind, "schema": json.loads(table.schema.json())})
            table.sparkSession.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(_schema_path(path, name))
            written.append(name)
    return written


def read_artefact(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table that ``write_artefacts`` left, with the types it was written with."""
    held = json.loads(spark.read.text(_schema_path(path, name)).first()["value"])
    read = spark.read.schema(StructType.fromJson(held["schema"])).option("dateFormat", "yyyy-MM-dd")
    return (read.option("header", True) if held["kind"] == "csv" else read).format(held["kind"]).load(f"{path.rstrip('/')}/{name}")

"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempo.functions.storage import cut_lineage, free_folder, shared_folder, shuffles_freed

__all__ = ["cut_lineage", "doc_texts", "drop_folder", "free_folder", "free_name", "in_tasks", "shared_folder", "shuffles_freed", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null becomes empty), so other columns never clash with working ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder (``path`` is a new folder in it), for what several steps read."""
    path = path or free_folder(df.sparkSession, "table")
    with shuffles_freed(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark keeps it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_tasks(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows dealt over the shuffle partitions by ``keys``."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only a local session without one gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def keep_until_exit(spark: SparkSession, path: str) -> str:
    """``path``, whose folder is deleted when the driver ends: results that read it may be asked for until then."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())

    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended before
            system.delete(target, True)

    atexit.register(drop)
    return path


def free_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one, kept until the driver ends."""
    return keep_until_exit(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


#: Spark's own setting: a query that begins while it is on has its shuffle files deleted when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """DataFrames that are made inside free their shuffle files as soon as they have run, not when the driver collects its garbage."""
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder; the shuffles that made the rows are freed at once, those of ``df`` itself are not touched."""
    shared_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint()

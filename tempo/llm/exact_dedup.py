"""Exact deduplication that stays balanced when one text holds a large share of all rows.

Copies are combined three times, each time by digest *and* full content: inside every map task (the partial
aggregate), across tasks per (digest, salt), and across the few salt winners per digest. A task therefore sees at
most one row per content from each task before it, however many copies there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempo.llm.common import cut_lineage, doc_texts, free_name

WHITESPACE = " \t\n\x0b\f\r"
_WIDE = "decimal(38,0)"
_SPAN = 10**20  # more than the number of longs
_TOP = 2**63


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(text, WHITESPACE, "")


def _wide(n: int) -> Column:
    return F.lit(str(n)).cast(_WIDE)


def _rank() -> Column:
    """One number that orders rows by length, then by smaller doc_id (null last); a decimal stays in hash aggregation."""
    nearer = F.coalesce(_wide(_TOP) - F.col("doc_id").cast(_WIDE), _wide(0))
    return (F.col("n_chars").cast(_WIDE) * _wide(_SPAN) + nearer).cast(_WIDE)


def _rows(docs: DataFrame, digest) -> DataFrame:
    return (
        doc_texts(docs)
        .select("doc_id", F.length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("content"))
        .withColumn("text_sha256", F.sha2("content", 256))
        .withColumn("digest", digest(F.col("content")) if digest else F.col("text_sha256"))
    )


def repeated_contents(docs: DataFrame, salts: int = 16, digest=None) -> DataFrame:
    """One row per content that several rows have, or whose digest several contents share.

    Columns: digest, content (null unless the digest is shared), variants, keep_id, keep_chars, group_size.
    """
    salted = (
        _rows(docs, digest)
        .withColumn("rank", _rank())
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    )
    winners = (
        salted.drop("salt").repartition("digest").groupBy("digest", "content").agg(F.max("rank").alias("rank"), F.sum("n").alias("group_size"))
        .withColumn("variants", F.count(F.lit(1)).over(Window.partitionBy("digest")))
        .filter("group_size > 1 or variants > 1")
    )
    nearer = F.col("rank") % _wide(_SPAN)
    return winners.select(
        "digest",
        F.when(F.col("variants") > 1, F.col("content")).alias("content"),
        "variants",
        F.when(nearer > 0, _wide(_TOP) - nearer).cast("long").alias("keep_id"),
        ((F.col("rank") - nearer) / _wide(_SPAN)).cast("long").alias("keep_chars"),
        "group_size",
    )


def exact_dedup(docs: DataFrame, salts: int = 16, digest=None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after ASCII white space is deleted; the longest original (code points), then the
    smallest doc_id stays. Null texts count as empty and so equal each other and blank texts. A null doc_id orders
    last. Rows that repeat both doc_id and text each count in group_size and are marked alike. An empty table gives
    an empty result. ``digest`` replaces SHA-256 as the grouping digest (tests use a weak one): contents that share a
    digest are still told apart.
    """
    return _judged(docs, salts, digest).drop("n_chars")


def _judged(docs: DataFrame, salts: int, digest=None) -> DataFrame:
    """The rows of ``exact_dedup`` with their length, n_chars."""
    winners = cut_lineage(repeated_contents(docs, salts, digest))
    rows = _rows(docs, digest)
    out = rows.drop("content").join(winners.filter("variants = 1").drop("content"), "digest", "left")
    if not winners.filter("variants > 1").isEmpty():
        shared = winners.filter("variants > 1").select("digest", "content", F.lit(True).alias("is_shared"), "keep_id", "keep_chars", "group_size")
        digests = shared.select("digest").distinct()
        out = out.join(digests, "digest", "left_anti").drop("variants").unionByName(rows.join(shared, ["digest", "content"]).drop("content", "is_shared"))
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def drop_copies(docs: DataFrame, salts: int = 16) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps.

    Rows that repeat a kept row's doc_id and text stay with it.
    """
    owner, sha, size = (free_name(docs, n) for n in ("gone_id", "gone_sha", "gone_size"))
    gone = _judged(docs, salts).filter("not kept").select(F.col("doc_id").alias(owner), F.col("text_sha256").alias(sha), F.col("n_chars").alias(size)).distinct()
    text = F.coalesce("text", F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(owner)) & (F.sha2(normalised(text), 256) == F.col(sha)) & (F.length(text) == F.col(size))
    return docs.join(gone, same, "left_anti")


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
  FROM n WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""

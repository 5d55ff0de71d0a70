"""The corpus pipeline: toxicity filter, exact and near deduplication, removal of repeated spans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows as Parquet to the
shared folder and reads them back as the next one's documents, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempo.llm import exact_dedup, packing, sentence_spans, simhash, toxicity
from tempo.llm.common import drop_folder, free_folder, free_name, table


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled documents of the input, does not reject.

    The model is fitted to the stage's own documents and scores each text in place. Null and empty texts stay, as they
    hold no insult; a score of exactly 0.5 goes; very long texts are read whole; repeated rows share their fate; a null
    doc_id has no label and is scored. All columns are kept, whatever their names. An empty table gives an empty result.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest doc_id.

    Null texts count as empty and equal blank ones; a null doc_id orders last; rows that repeat the one that stays stay
    with it. All columns are kept, whatever their names. An empty table gives an empty result.
    """
    return exact_dedup.drop_copies(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that shares 0.8 of its five-word shingles.

    Null and blank texts and rows with a null doc_id take no part and stay; rows that repeat a doc_id share its fate.
    All columns are kept, whatever their names. An empty table gives an empty result.
    """
    gone = free_name(docs, "gone_id")
    groups = simhash.near_duplicates(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias(gone))
    return docs.join(groups, F.col("doc_id") == F.col(gone), "left_anti")


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without sentences of spans that an earlier place has; n_chars follows the text.

    A null text becomes empty; a null doc_id orders last; repeated rows of one doc_id are one document. All columns are
    kept: those named as the operator's own counts are set aside. An empty table gives an empty result.
    """
    own = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in ("n_sentences", "n_removed")}
    done = sentence_spans.remove_repeated_spans(docs.withColumnsRenamed(own)).drop("n_sentences", "n_removed").withColumnsRenamed({v: k for k, v in own.items()})
    return done.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows, one row each; the columns of documents end here.

    A null or empty text is its end id alone; repeated rows and null ids are packed like others; an empty table gives
    an empty result.
    """
    return packing.packed_pieces(docs)


STAGES = [
    ("toxicity", keep_clean),
    ("exact_dedup", keep_first_copies),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("sentence_spans", cut_repeated_spans),
    ("packing", pack),
]

#: Training, near-duplicate groups and tokenization are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's folder is deleted when the next one's is complete, the last when the driver ends."""
    base = free_folder(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            drop_folder(spark, before)
        before = f"{base}/{name}"
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

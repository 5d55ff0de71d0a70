"""Token counts through a cache of digests.

A text's tokens depend on its normalised content and on the tokenizer's files alone. So every text is reduced to a digest
of the content as the tokenizer normalises it, joined to the counts stored for that tokenizer's version (a digest of its
file), and only one text per missing digest is encoded; the new counts are appended to the cache, which later tables use.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempo.llm.common import doc_texts, free_folder, free_name
from tempo.llm.packing import token_ids

LIMIT = 512
CACHE = "digest binary, n_tokens long"
_AT_ONCE = 4_000_000  # characters that are encoded together


@functools.lru_cache(maxsize=4)
def _library(path: str):
    """The library's own tokenizer: of a .model file sentencepiece's, else that of tokenizers without its cuts and pads."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.lru_cache(maxsize=4)
def _ranked(path: str) -> bool:
    """Whether the file's ids are byte-level merges by rank, which tiktoken makes three times as fast as its library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    merged = ["".join(m if isinstance(m, list) else m.split(" ", 1)) for m in model.get("merges", ())]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    own = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].startswith("<|") for t in spec["added_tokens"])
    levels = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    return bool(model["type"] == "BPE" and plain and own and levels and not spec["normalizer"] and all(model["vocab"][m] == 256 + i for i, m in enumerate(merged)))


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer's file: a changed vocabulary never meets counts of another."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each text as the file's library gives them, without begin, end or added special tokens."""
    library = _library(path)
    if path.endswith(".model"):
        return [len(ids) for ids in library.encode(texts, num_threads=1)]
    if _ranked(path):
        return [len(token_ids(text, path)) - 1 for text in texts]  # without the end id
    return [len(library.encode(text, add_special_tokens=False).ids) for text in texts]


def _normalized(path: str) -> bool:
    """Whether the tokenizer rewrites a text before it splits it, as a rule of its own that the digest may follow."""
    return not path.endswith(".model") and _library(path).normalizer is not None


def content(text: Column, path: str) -> Column:
    """The text as the tokenizer's own normaliser leaves it; itself where there is none.

    Special tokens are sought in the text as written, so texts that hold one keep their spelling.
    """
    if not _normalized(path):
        return text

    @F.pandas_udf("string")
    def rewrite(texts):
        library = _library(path)
        special = [t.content for t in library.get_added_tokens_decoder().values()]
        return texts.map(lambda t: t if any(s in t for s in special) else library.normalizer.normalize_str(t))

    return rewrite(text)


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """One row per digest that the cache holds for this version; empty if it has no such folder yet.

    Two runs may append the same digest at the same time; their counts are equal, so one of them is taken.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={version}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE)
    held = spark.read.schema(CACHE).option("recursiveFileLookup", "true").parquet(f"{cache}/version={version}")
    return held.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def encode_misses(texts: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens of rows (digest, content): whole texts, a few million characters at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held = 0, 0
            for i, text in enumerate(found := batch["content"].to_pylist()):
                held += len(text)
                if held >= _AT_ONCE or i + 1 == len(found):
                    part = found[begin : i + 1]
                    yield pa.record_batch({"digest": batch["digest"].slice(begin, len(part)), "n_tokens": pa.array(count_tokens(part, path), pa.int64())})
                    begin, held = i + 1, 0

    return texts.select("digest", "content").mapInArrow(run, CACHE)


def with_token_counts(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """Adds n_bytes (UTF-8, of the text as written) and n_tokens to all rows; their names avoid those of other columns.

    Digests are of 256 bits, so they decide equality. A null text counts as empty, which has no tokens. Repeated texts,
    in the table or from earlier calls, are encoded once; a very long text is encoded whole. Ties do not arise. Null ids
    and repeated rows stay as they are. An empty table gives an empty result and adds nothing to the cache.
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    key, count, size = free_name(docs, "digest"), free_name(docs, "n_tokens"), free_name(docs, "n_bytes")
    keyed = docs.withColumn(key, F.unhex(F.sha2(content(text, path), 256)))
    held = stored_counts(spark, cache, version)
    # a text that a third of the rows share is reduced to one per task before it is dealt
    texts = docs.select(content(text, path).alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    missing = texts.groupBy("digest").agg(F.any_value("content").alias("content")).join(held.select("digest"), "digest", "left_anti")
    encode_misses(missing, path).write.parquet(f"{cache}/version={version}/run-{uuid.uuid4().hex}")
    known = stored_counts(spark, cache, version).select(F.col("digest").alias(key), F.col("n_tokens").alias(count))
    return keyed.withColumn(size, F.octet_length(text).cast("long")).join(known, key, "left").drop(key)


def token_counts(docs: DataFrame, path: str | None = None, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), one row per row of ``docs``.

    ``cache`` is a folder that all runs share; without one the call starts from an empty cache of its own, deleted when
    the driver ends. Nulls, empty and very long texts, repeated rows and empty tables as in ``with_token_counts``.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if cache is None:
        cache = free_folder(docs.sparkSession, "token-counts")
    found = with_token_counts(doc_texts(docs), path, cache)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Substring deduplication by sliding runs of sentences.

Every run of two consecutive sentences with enough words, and every longer run that short sentences need to have enough
words, is hashed. A sentence of ALONE words or more, as long as several, is a run by itself: its neighbours differ from
place to place, and a passage of one such sentence would stay otherwise. The first document (smallest doc_id, first
place in it) keeps a run; sentences that any other occurrence covers go. Runs are written once, counted by a map-side
aggregate and joined back by their hash to counts that are cut off from that aggregate, so that Spark can split the
occurrences of a run that very many documents share over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempo.llm.common import cut_lineage, doc_texts, free_name, written

RUN = 2  # sentences in a run, at least
MIN_WORDS = 10  # words in a run, at least
ALONE = 25  # words of a sentence that is a run by itself
_END = re.compile(r"(?<=[.!?])\s+|\n\s*")


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Character ranges that make up the whole text: a sentence ends after [.!?] and white space, or after a line."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def runs(text: str, parts: list[tuple[int, int]]) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, digest) of every run; sentences without words are left out of account.

    Two sentences with fewer words than MIN_WORDS are extended to the shortest run that has them, once onwards and once
    backwards, so that the short lines at both ends of a passage are in runs within it too.
    """
    digest = xxhash.xxh3_128_digest
    found, held = [], []
    for i, (a, b) in enumerate(parts):
        words = text[a:b].lower().split()
        if not words:
            continue
        n, key = len(words), digest(" ".join(words).encode())
        if n >= ALONE:
            found.append((i, i, key))
        held.append((i, n, key))
    spans = set()
    for i in range(len(held) - RUN + 1):
        total = sum(h[1] for h in held[i : i + RUN])
        low, high, words = i, i + RUN, total
        while words < MIN_WORDS and high < len(held):
            words += held[high][1]
            high += 1
        if words >= MIN_WORDS:
            spans.add((i, high))
        words = total
        while words < MIN_WORDS and low > 0:
            low -= 1
            words += held[low][1]
        if words >= MIN_WORDS:
            spans.add((low, i + RUN))
    found += [(held[low][0], held[high - 1][0], digest(b"".join(h[2] for h in held[low:high]))) for low, high in spans]
    return [(first, last - first + 1, key) for first, last, key in sorted(found)]


def _marks(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, at, n: the runs of each document, each digest once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                rows, firsts, sizes, keys = [], [], [], []
                for k, text in enumerate(part["text"]):
                    once = {}
                    for first, n, key in runs(text, split_sentences(text)):
                        once.setdefault(key, (first, n))
                    rows += [k] * len(once)
                    keys += once
                    firsts += [f for f, _ in once.values()]
                    sizes += [n for _, n in once.values()]
                hashes = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
                yield pd.DataFrame({"h1": hashes[:, 0], "h2": hashes[:, 1].astype(np.int32), "doc_id": part["doc_id"].astype("Int64").to_numpy()[rows] if rows else pd.array([], dtype="Int64"), "at": np.array(firsts, dtype=np.int32), "n": np.array(sizes, dtype=np.int16)})

    return doc_texts(docs).mapInPandas(run, "h1 long, h2 int, doc_id long, at int, n short")


def _without(text: str, later: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the sentences of ``later`` runs and of runs that stood in it before; sentences; removed ones."""
    parts = split_sentences(text)
    gone = np.zeros(len(parts), dtype=bool)
    for first, n in later:
        gone[first : first + n] = True
    seen = set()
    for first, n, key in runs(text, parts):
        if key in seen:
            gone[first : first + n] = True
        seen.add(key)
    if not gone.any():
        return text, len(parts), 0
    return "".join(text[a:b] for (a, b), g in zip(parts, gone, strict=True) if not g), len(parts), int(gone.sum())


def remove_repeated_spans(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with repeated sentences cut from ``text``, and n_sentences, n_removed.

    The rest of a text is left as it was; a text may become empty, a null one does too. Rows with the same doc_id are
    one document, whose own runs are told apart by place only; a null doc_id orders last. Columns named n_sentences
    or n_removed are replaced. An empty table gives an empty result.
    """
    marks = written(_marks(docs))
    firsts = cut_lineage(marks.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("held")).filter("held > 1").drop("held"))
    later = marks.join(firsts, ["h1", "h2"]).filter("first_id is not null and not doc_id <=> first_id")
    kept = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")]
    rows = docs.select(*kept)
    owner, spans, done = (free_name(rows, n) for n in ("cut_id", "cuts", "done"))
    cuts = later.groupBy(F.col("doc_id").alias(owner)).agg(F.collect_set(F.struct("at", "n")).alias(spans))  # bounded by the document

    @F.pandas_udf("text string, n_sentences int, n_removed int")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        found = [_without(t or "", [(s["at"], s["n"]) for s in later] if later is not None else []) for t, later in zip(texts, spans, strict=True)]
        return pd.DataFrame(found, columns=["text", "n_sentences", "n_removed"])

    joined = rows.join(cuts, F.col("doc_id").cast("long").eqNullSafe(F.col(owner)), "left").withColumn(done, cut(F.col("text"), F.col(spans)))
    return joined.select(*[F.col(f"{done}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in kept], f"{done}.n_sentences", f"{done}.n_removed")


def span_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, text (what is left), n_sentences, n_removed, n_chars (of what is left).

    Null texts become empty; very long ones are read whole; null ids, repeated rows and empty tables as in
    ``remove_repeated_spans``. Other columns
    are not read, so none can clash.
    """
    return remove_repeated_spans(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_sentences", "n_removed", F.length("text").cast("long").alias("n_chars"))

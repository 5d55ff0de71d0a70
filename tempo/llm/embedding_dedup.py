"""Embedding near-deduplication by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the signed axis nearest to the
result is one hash. A bucket is three such hashes; every vector is stored in one bucket per table and probes the
buckets it nearly fell into as well. Pairs that meet are verified by cosine in double precision. Equal vectors are
one class from the start, so copies never pair out. Pairs are found with a probability well above 0.99 at the
default sizes; none below the threshold is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempo.llm.common import cut_lineage
from tempo.llm.components import connected_components

THRESHOLD = 0.95
TABLES, AXES, PROBES = 10, 3, 9
_NEAR = 3  # axes considered for each of a bucket's hashes


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(rows, width // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(rows, width)
        step *= 2
    return x / np.sqrt(width)


def _nearest_axes(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The signed axes nearest to each rotated row, best first, and how much worse than the best each is."""
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice((-1.0, 1.0), size=x.shape[1]))
    size = np.abs(x)
    near = np.argpartition(-size, min(_NEAR, x.shape[1]) - 1, axis=1)[:, :_NEAR]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(size, near, 1), axis=1, kind="stable"), 1)
    held = np.take_along_axis(size, near, 1)
    sign = np.take_along_axis(x, near, 1) < 0
    return 2 * near + sign, (held[:, :1] - held) ** 2


def buckets(vectors: np.ndarray, tables: int = TABLES, axes: int = AXES, probes: int = PROBES) -> np.ndarray:
    """[row, table, probe] bucket numbers; probe 0 is the row's own bucket."""
    rows, dim = vectors.shape
    width = max(4, 1 << (dim - 1).bit_length())
    x = np.zeros((rows, width))
    x[:, :dim] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.zeros((rows, tables, probes), dtype=np.int64)
    for t in range(tables):
        bucket, cost = np.full((rows, 1), t, dtype=np.int64), np.zeros((rows, 1))
        for a in range(axes):
            axis, worse = _nearest_axes(x, 1000 * t + a)
            bucket = (bucket[:, :, None] * (2 * width) + axis[:, None, :]).reshape(rows, -1)
            cost = (cost[:, :, None] + worse[:, None, :]).reshape(rows, -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(bucket, best, 1)
    return out


def _usable() -> Column:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, axes: int = AXES, probes: int = PROBES) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null vec_id, link with
    nothing: n_links is 0 and component_id their own vec_id. Vectors of different lengths never link. Equal vectors
    always link; repeated rows count as further vectors. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = _usable()
    members = rows.filter(usable)
    classes = cut_lineage(members.groupBy("embedding").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("size")))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["embedding"].map(len)):
                found = buckets(np.array(part["embedding"].tolist(), dtype=np.float64), tables, axes, probes)
                n = found.shape[1] * found.shape[2]
                yield pd.DataFrame({"cls": np.repeat(part["cls"].to_numpy(), n), "dim": np.int32(dim), "bucket": found.ravel(), "own": np.tile(np.arange(found.shape[2]) == 0, len(part) * found.shape[1])})

    marks = classes.select("cls", "embedding").mapInPandas(hashed, "cls long, dim int, bucket long, own boolean")
    met = marks.filter("own").select("dim", "bucket", F.col("cls").alias("a")).join(marks.select("dim", "bucket", F.col("cls").alias("b")), ["dim", "bucket"]).filter("a <> b")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = classes.select(F.col("cls").alias("a"), F.col("embedding").alias("x"), F.col("size").alias("size_a"))
    right = classes.select(F.col("cls").alias("b"), F.col("embedding").alias("y"), F.col("size").alias("size_b"))

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                for _, part in batch.groupby(batch["x"].map(len)):
                    x, y = np.array(part["x"].tolist(), dtype=np.float64), np.array(part["y"].tolist(), dtype=np.float64)
                    cosine = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                    yield part.loc[cosine >= threshold, ["a", "b", "size_a", "size_b"]]

    links = cut_lineage(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "size_a", "size_b").mapInPandas(verified, "a long, b long, size_a long, size_b long"))
    linked = links.select(F.col("a").alias("cls"), F.col("size_b").alias("others")).unionByName(links.select(F.col("b").alias("cls"), F.col("size_a").alias("others")))
    counts = linked.groupBy("cls").agg(F.sum("others").alias("others"))
    roots = connected_components(links.select("a", "b")).withColumnRenamed("node", "cls")
    facts = classes.join(counts, "cls", "left").join(roots, "cls", "left").select("embedding", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("component_id"))
    facts = facts.filter("n_links > 0")  # most vectors are alone and need no partner below
    out = rows.join(facts, "embedding", "left")
    name = F.when(usable, F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(usable, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), name.eqNullSafe(F.col("vec_id")).alias("kept"))

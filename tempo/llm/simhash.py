"""SimHash near-deduplication over a grid of per-segment bit counts.

A 64-bit fingerprint is embedded as 32 counts of set bits, one per two-bit segment. The Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints, so pairs within the radius are found by a range
join on the vectors and verified on the fingerprints. The range join cuts the vector into radius + 3 groups of
segments: vectors within the radius differ in at most ``radius`` groups and share the grid cell of three others.
Counts are kept in unary (0, 1, 2 -> 00, 01, 11), which makes Manhattan distance a bit count too.

Distinct fingerprints are joined, not documents. A crowded cell is not paired out: its fingerprints meet at their
one-bit neighbours instead, at most 65 rows each, which finds the same links for a radius of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempo.llm.common import cut_lineage, doc_texts, written
from tempo.llm.components import connected_components

RADIUS = 2
SEED = 42
CROWD = 32  # cells with more distinct fingerprints than this take the other exact way
_CHUNK = 1 << 16


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, A-Z lower-cased; of the whole sequence if it is shorter; none if empty."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(run), SEED) for run in runs), dtype=np.uint64, count=max(1, len(words) - size + 1))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set where more than half of the hashes set it; as a signed long."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (long) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": np.array([fingerprint(shingle_hashes(t, shingle)) for t in batch["text"]], dtype=np.int64)})

    return doc_texts(docs).mapInPandas(run, "doc_id long, fp long")


def _bits(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


_LOW = 0x5555555555555555


def segment_counts(fp: Column) -> Column:
    """Set bits per two-bit segment, in unary within the segment."""
    high = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(high).bitwiseAND(_bits(_LOW)), fp.bitwiseAND(high).bitwiseAND(_bits(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _cell_masks(radius: int) -> list[int]:
    """Masks over the embedding: every choice of three of radius + 3 groups of segments."""
    groups = [sum(3 << (2 * s) for s in range(g, 32, radius + 3)) for g in range(radius + 3)]
    return [a | b | c for a, b, c in combinations(groups, 3)]


def fingerprint_links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all within two bits of each other."""
    embedded = fps.select("fp", segment_counts(F.col("fp")).alias("counts"))
    masks = F.array(*[_bits(m) for m in _cell_masks(RADIUS)])
    cells = embedded.select("fp", "counts", F.posexplode(masks).alias("grid", "mask")).select("fp", "counts", "grid", F.col("counts").bitwiseAND(F.col("mask")).alias("cell"))
    shared = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    held = cut_lineage(cells.join(shared, ["grid", "cell"]))
    sparse = held.filter(F.col("members") <= crowd)
    near = F.bit_count(F.col("l.counts").bitwiseXOR(F.col("r.counts"))) <= RADIUS
    true = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= RADIUS
    on = (F.col("l.grid") == F.col("r.grid")) & (F.col("l.cell") == F.col("r.cell")) & (F.col("l.fp") < F.col("r.fp"))
    pairs = sparse.alias("l").join(sparse.alias("r"), on & near & true).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    flips = F.array(F.lit(0).cast("long"), *[_bits(1 << i) for i in range(64)])
    middles = (
        held.filter(F.col("members") > crowd).select("fp").distinct()
        .select("fp", F.explode(flips).alias("flip"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")).agg(F.sort_array(F.collect_list("fp")).alias("around"))  # 65 at most
        .filter(F.size("around") > 1)
        .select(F.col("around")[0].alias("a"), F.explode("around").alias("b")).filter("a <> b")
    )
    return pairs.unionByName(middles).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Fingerprints link at two or fewer differing bits. Null and blank texts have fingerprint zero and link like any
    other. A null doc_id is reported as null and never gives a component its name unless all in it are null. Repeated
    rows each give a row; ties of bits leave a bit unset; a very long text is read whole. An empty table gives an empty
    result. Other columns are not read.
    """
    rows = cut_lineage(fingerprints(docs, shingle))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = cut_lineage(connected_components(fingerprint_links(distinct, crowd)))
    linked = roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "least")
    named = linked.groupBy("root").agg(F.min("least").alias("component"))
    moved = linked.join(named, "root").select("fp", "component")
    # cut off from its aggregates, so that Spark can split the rows of one very frequent fingerprint over tasks
    names = cut_lineage(distinct.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")))
    return rows.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Documents of one similarity: the same machinery over several fingerprints per document


BANDS, SAMPLE = 12, 3
BLOCK = 256  # documents of a group that are compared with as many others at a time
_ODD = np.random.default_rng(7).integers(0, 2**63, size=BANDS * SAMPLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_fingerprints(hashes: np.ndarray) -> list[int]:
    """For each band, the SimHash of the three shingles that are least under the band's three orders."""
    least = [int((hashes * odd).min()) for odd in _ODD]
    out = []
    for a, b, c in zip(least[0::3], least[1::3], least[2::3], strict=True):
        bits = (a & b) | (a & c) | (b & c)
        out.append(bits - (1 << 64) if bits >> 63 else bits)
    return out


def _jaccard(a: bytes, b: bytes) -> float:
    """Of two sets of distinct hashes."""
    x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _links_between(part: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Pairs (a, b) that join all documents of different roots that reach ``similarity``, found by comparing all of side
    0 with all of side 1, or with each other if there is no side 1. ``shingles`` holds distinct hashes as bytes.
    """
    ids, side, label = part["doc_id"].to_numpy(), part["side"].to_numpy(), np.unique(part["root"], return_inverse=True)[1]
    sets = [np.frombuffer(b, dtype="<u8") for b in part["shingles"]]
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    theirs = np.concatenate([flat[ends[j] - sizes[j] : ends[j]] for j in right])
    owner = np.repeat(np.arange(len(right)), sizes[right])
    mark = np.zeros(len(flat), dtype=bool)
    found = []
    for i in left:
        if (label[right] == label[i]).all():
            continue
        own = flat[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        both = np.bincount(owner[mark[theirs]], minlength=len(right))
        mark[own] = False
        for j in right[both / (sizes[i] + sizes[right] - both) >= similarity]:
            if label[j] != label[i]:
                found.append((ids[i], ids[j]))
                label[label == label[j]] = label[i]
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _rest_of_links(sets: DataFrame, groups: DataFrame, roots: DataFrame, similarity: float, block: int) -> DataFrame:
    """Edges (a, b) that connect what reaches ``similarity`` within a group (band, fp) and is not of one root so far.

    Only pairs of the same root are passed over, since they are connected already. A group is cut into blocks of about
    ``block`` documents, and every pair of blocks is one task's work; roots with more documents have blocks of their
    own, which need not meet each other.
    """
    placed = groups.join(roots, groups.doc_id == roots.node, "left").select("band", "fp", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    counted = placed.groupBy("band", "fp", "root").agg(F.count(F.lit(1)).alias("held"))
    mixed = counted.groupBy("band", "fp").agg(F.sum("held").alias("n"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").drop("roots")
    own = F.concat_ws(":", F.lit("root"), "root", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("held") / block)))
    shared = F.concat_ws(":", F.lit("rest"), F.pmod(F.xxhash64("root"), F.ceil(F.col("n") / block)))
    members = cut_lineage(placed.join(counted.join(mixed, ["band", "fp"]), ["band", "fp", "root"]).select("band", "fp", "doc_id", "root", F.when(F.col("held") > block, own).otherwise(shared).alias("block")))
    blocks = members.select("band", "fp", "block").distinct()
    one_root = F.startswith("i", F.lit("root:")) & (F.substring_index("i", ":", 2) == F.substring_index("j", ":", 2))
    pairs = blocks.withColumnRenamed("block", "i").join(blocks.withColumnRenamed("block", "j"), ["band", "fp"]).filter((F.col("i") <= F.col("j")) & ~one_root)
    sides = pairs.select("band", "fp", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(pairs.filter("i <> j").select("band", "fp", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))

    work = members.join(sides, ["band", "fp", "block"]).select("doc_id", "root", "band", "fp", "i", "j", "side").join(sets, "doc_id")
    return work.groupBy("band", "fp", "i", "j").applyInPandas(lambda part: _links_between(part, similarity), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, centres: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, component_id of documents whose sets of word shingles reach ``similarity``, directly or by a chain.

    Candidates: documents whose whole fingerprints link (see ``fingerprint_links``) and documents that share one of
    twelve band fingerprints, each the SimHash of a min-wise sample of three shingles; a pair at 0.8 shares one with
    probability above 0.999. Within a group every document is first compared with one centre per band, drawn in
    ``centres`` different orders; then all pairs of a group that these links leave unconnected are compared, in blocks
    of ``block`` documents. Each comparison is exact, so every candidate pair at ``similarity`` ends in one component.
    Only rows in a group are returned. Rows with a null doc_id and documents without words take no part.
    """
    texts = doc_texts(docs).filter("doc_id is not null").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, bands, fps = [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                hashes = shingle_hashes(text, shingle)
                if len(hashes):
                    found = [fingerprint(hashes), *band_fingerprints(hashes)]
                    ids += [doc_id] * len(found)
                    bands += range(len(found))
                    fps += found
            yield pd.DataFrame({"doc_id": np.array(ids, dtype=np.int64), "band": np.array(bands, dtype=np.int32), "fp": np.array(fps, dtype=np.int64)})

    marks = cut_lineage(texts.mapInPandas(run, "doc_id long, band int, fp long"))
    whole = marks.filter("band = 0")
    roots = connected_components(fingerprint_links(whole.select("fp").distinct()))
    grouped = whole.join(roots, whole.fp == roots.node, "left").select("doc_id", "band", F.coalesce("root", "fp").alias("fp")).unionByName(marks.filter("band > 0"))
    turn = F.col("band") % centres
    centre = cut_lineage(grouped.groupBy("band", "fp").agg(F.min(F.struct(F.xxhash64("doc_id", turn).alias("o"), F.col("doc_id").alias("id"))).alias("c"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "fp", F.col("c.id").alias("centre")))
    held = cut_lineage(grouped.join(centre, ["band", "fp"]))
    edges = held.filter("doc_id <> centre").select(F.greatest("doc_id", "centre").alias("a"), F.least("doc_id", "centre").alias("b")).distinct()

    def distinct_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"], "shingles": [np.unique(shingle_hashes(t, shingle)).astype("<u8").tobytes() for t in part["text"]]})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = [_jaccard(x, y) >= similarity for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.loc[hit, ["a", "b"]]

    # texts are hashed once more for those that have a partner only; sets are what is compared from here on
    sets = written(texts.join(cut_lineage(held.select("doc_id").distinct()), "doc_id", "left_semi").mapInPandas(distinct_shingles, "doc_id long, shingles binary"))
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    true = edges.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(verify, "a long, b long")
    first = cut_lineage(connected_components(true))
    rest = _rest_of_links(sets, held.select("band", "fp", "doc_id"), first, similarity, block)
    every = first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest)
    return connected_components(every).withColumnsRenamed({"node": "doc_id", "root": "component_id"})

"""Substring deduplication of long byte strings with suffix arrays per shard.

Every window of ``length`` bytes is assigned to the position in it whose k-mer has the least hash (its minimizer).
Equal windows have equal minimizers, so consecutive windows that share one form a segment, and a window can only
recur in segments of the same minimizer hash. Segments that recur as a whole are settled by counting digests. Where
one hash has different segments, one copy of each goes to a shard, which sorts all suffixes by Larsson-Sadakane
refinement and takes common prefixes from Kasai's theorem; windows whose prefix with a neighbour reaches ``length``
recur. A hash with very many different segments is cut into several shards, whose distinct windows are merged by
binary search over their digests; only windows whose core, the bytes that they share with their neighbours on STEP
places, stands in two segments get that far.

A second, smaller number of bytes (``passage``) is answered in the same pass, for repeats that are reported and stay: the
minimizers are those of its windows, and a segment's string reaches ``length`` bytes from its last window, or to the end
of the text. Equal strings of ``length`` bytes begin with equal windows, so their segments meet as well.

Equal segments and, between shards, equal windows are told by 96 and 128 bits of XXH3 without comparing bytes: among 2^40
segments two different ones agree with a chance of 2^-17, and such a pair would be removed as a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempo.llm.common import cut_lineage, doc_texts, drop_folder, free_folder, written

LENGTH = 400
PASSAGE = 256  # bytes of some 50 words, of four letters and a space: repeats that are reported only
KMER = 48
SHARD = 2048  # segments of one minimizer hash in a shard
STEP = 16  # windows of a segment that are asked for together, by the bytes they share
_AT_ONCE = 1 << 20  # bytes that are hashed or sorted together
_BASE = 0x9E3779B97F4A7C15


def _kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position; positions without k bytes get hashes too, of no meaning."""
    n = len(data)
    power = np.multiply.accumulate(np.full(n + 1, _BASE, dtype=np.uint64))
    inverse = np.multiply.accumulate(np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    end = np.minimum(np.arange(n) + k, n)
    x = (total[end] - total[:n]) * inverse[:n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def segments(texts: list[bytes], length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """(text number, first window, number of windows, minimizer position, minimizer hash) of every segment."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n = int(sizes.sum())
    if not n or sizes.max() < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    hashes = _kmer_hashes(data, kmer)
    low = np.uint64((1 << max(20, n.bit_length())) - 1)
    key = (hashes & ~low) | np.arange(n, dtype=np.uint64)
    wide = length - kmer + 1
    rows = -(-(n + wide) // wide)
    block = np.full(rows * wide, np.iinfo(np.uint64).max, dtype=np.uint64)
    block[:n] = key
    block = block.reshape(rows, wide)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & low
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    valid = np.flatnonzero(begin[1:][owner] - np.arange(n) >= length)
    anchor = least[valid].astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(valid) != 1)]))
    first, counts = valid[heads], np.diff(np.concatenate([heads, [len(valid)]]))
    text = owner[first]
    return text, first - begin[text], counts, anchor[heads] - begin[text], hashes[anchor[heads]].astype(np.int64)


def suffix_array(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Suffixes of all parts in order, each part ended by a mark of its own.

    Returns (order, rank, prefix, start of each part, remaining bytes of each position) over the parts laid out with
    eight bytes between them; prefix[p] is the common prefix of p with the suffix before it in the order.
    """
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 8)])[:-1]
    data = np.frombuffer(b"".join(p + bytes(8) for p in parts) + bytes(8), dtype=np.uint8)
    n = len(data) - 8
    part = np.repeat(np.arange(len(parts)), sizes + 8)
    remaining = np.maximum(begin[part] + sizes[part] - np.arange(n), 0)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | data[i : i + n]
    order = np.flatnonzero(remaining)
    order = order[np.argsort(key[order], kind="stable")]
    rank = np.zeros(n, dtype=np.int64)

    def heads_of(values: np.ndarray) -> np.ndarray:
        return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=bool)

    head = heads_of(key[order])
    group = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0)) if len(order) else order
    rank[order] = group
    alone = head & np.concatenate([head[1:], [True]]) if len(order) else head
    at, h = np.flatnonzero(~alone), 8
    while len(at):  # only groups that are not settled are refined
        p = order[at]
        beyond, over = rank[np.minimum(p + h, n - 1)], h >= remaining[p]  # ended ones: the shorter is less, then by part
        beyond[over] = np.unique(remaining[p[over]] * len(parts) + len(parts) - 1 - part[p[over]], return_inverse=True)[1] - n
        both = (rank[p] << 32) + (beyond + (1 << 31))
        turn = np.argsort(both, kind="stable")
        p, both = p[turn], both[turn]
        order[at] = p
        head = heads_of(both)
        rank[p] = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        alone = head & np.concatenate([head[1:], [True]])
        at, h = at[~alone], 2 * h
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    # Kasai: where the bytes before both suffixes agree, the prefix is one less than that of the position before
    p = np.flatnonzero((remaining > 0) & (before >= 0))
    q = before[p]
    starts = np.zeros(n, dtype=bool)
    starts[begin[sizes > 0]] = True
    head = starts[p] | starts[q] | (data[p - 1] != data[q - 1])
    size = np.zeros(len(p), dtype=np.int64)
    live = np.flatnonzero(head)
    limit = np.minimum(remaining[p], remaining[q])
    while len(live):
        i, j = p[live] + size[live], q[live] + size[live]
        differ = key[i] ^ key[j]
        same = np.full(len(live), 8, dtype=np.int64)
        for b in range(7, -1, -1):
            same[(differ >> np.uint64(56 - 8 * b)) & np.uint64(255) != 0] = b
        size[live] = np.minimum(size[live] + same, limit[live])
        live = live[(same == 8) & (size[live] < limit[live])]
    prefix = np.zeros(n, dtype=np.int64)
    prefix[p] = size
    chain = np.zeros(n, dtype=np.int64)
    chain[p[head]] = p[head]
    chain[order[:1]] = order[:1]
    back = np.maximum.accumulate(chain)
    prefix[p] = prefix[back[p]] - (p - back[p])
    return order, rank, prefix, begin, remaining


def repeated_windows(parts: list[bytes], counts: list[int], lengths: list[int]) -> list[tuple[list[np.ndarray], list[np.ndarray]]]:
    """For each length, per part: which of its first windows (``counts``) occur again as such a one in any part, and which
    one of each set of equal windows represents it. What follows the first windows of a part only goes on with them."""
    order, _, prefix, begin, remaining = suffix_array(parts)
    counted = np.zeros(len(remaining), dtype=bool)
    for b, c in zip(begin, counts, strict=True):
        counted[b : b + c] = True
    at = np.flatnonzero(counted[order])
    common = np.zeros(len(at), dtype=np.int64)
    if len(at):  # the common prefix with the counted suffix before is the least one on the way
        common[1:] = np.minimum.reduceat(prefix[order[: at[-1] + 1]], at[:-1] + 1)
    order = order[at]
    found = []
    for length in lengths:
        met = common >= length
        again = np.zeros(len(remaining), dtype=bool)
        again[order] = met | np.concatenate([met[1:], [False]])[: len(met)]
        first = np.zeros(len(remaining), dtype=bool)
        first[order] = ~met & (remaining[order] >= length)
        found.append(([again[b : b + c] for b, c in zip(begin, counts, strict=True)], [first[b : b + c] for b, c in zip(begin, counts, strict=True)]))
    return found


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of set flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


_SEGMENT = "anchor long, d1 long, d2 int, id long, mark long, first int, n int, anchor_at int"
_COVER = "array<struct<lo: int, hi: int, size: int>>"


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key that is never null: the id, or else a hash of the text, and another hash of the text.

    Rows of one key have the same text, and so the same cuts.
    """
    return doc_texts(docs).select("doc_id", F.coalesce("doc_id", F.xxhash64(F.lit("no id"), "text")).alias("id"), F.xxhash64("text").alias("mark"), "text")


def _segments(keyed: DataFrame, least: int, length: int, kmer: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() for t in batch["text"]]
            ids, marks = batch["id"].to_numpy(), batch["mark"].to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // _AT_ONCE)) + 1
            for rows in np.split(np.arange(len(texts)), cuts):
                part = [texts[i] for i in rows]
                text, first, n, anchor, hashed = segments(part, least, kmer)
                digests = b"".join(
                    xxhash.xxh3_128_digest(part[t][a : a + c + length - 1], seed=int(m - a)) for t, a, c, m in zip(text.tolist(), first.tolist(), n.tolist(), anchor.tolist(), strict=True)
                )
                d = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
                yield pd.DataFrame({"anchor": hashed, "d1": d[:, 0], "d2": d[:, 1].astype(np.int32), "id": ids[rows][text], "mark": marks[rows][text], "first": first.astype(np.int32), "n": n.astype(np.int32), "anchor_at": (anchor - first).astype(np.int32)})

    return keyed.select("id", "mark", "text").mapInPandas(run, _SEGMENT)


def _sorted_shards(segments_: DataFrame, lengths: list[int]) -> DataFrame:
    """anchor, d1, d2, cover, groups: what recurs within the shard; of split hashes also the digests of distinct windows.

    Windows are grouped by their distance to the minimizer, STEP at a time, under a digest of that and of the bytes all
    windows of such a group hold: equal windows are in groups of equal digests.
    """

    def digest(body: bytes, seed: int) -> tuple[int, int]:
        return tuple(np.frombuffer(xxhash.xxh3_128_digest(body, seed=seed), dtype="<i8").tolist())

    def flush(rows: list) -> pd.DataFrame:
        cover, groups = [[] for _ in rows], [[] for _ in rows]
        for size, (again, first) in zip(lengths, repeated_windows([r.body for r in rows], [r.n for r in rows], lengths), strict=True):
            for i, (r, hit, one) in enumerate(zip(rows, again, first, strict=True)):
                cover[i] += [{"lo": a, "hi": b, "size": size} for a, b in _ranges(hit)]
                held = {}
                for at in np.flatnonzero(one).tolist() if r.split else []:
                    w1, w2 = digest(r.body[at : at + size], 0)
                    held.setdefault((r.anchor_at - at) // STEP, []).append({"w1": w1, "w2": w2, "at": at, "size": size})
                for q, windows in held.items():
                    begin = r.anchor_at - q * STEP  # the last window's first byte; the first window's last byte ends the core
                    c1, c2 = digest(r.body[begin : max(begin, begin - STEP + 1 + size)], q << 32 | size)
                    groups[i].append({"c1": c1, "c2": c2, "windows": windows})
        out = [(r.anchor, r.d1, r.d2, c, g) for r, c, g in zip(rows, cover, groups, strict=True)]
        return pd.DataFrame(out, columns=["anchor", "d1", "d2", "cover", "groups"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held, last = [], 0, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.anchor, r.shard) != last and held > _AT_ONCE:
                    yield flush(rows)
                    rows, held = [], 0
                last = (r.anchor, r.shard)
                rows.append(r)
                held += len(r.body)
        if rows:
            yield flush(rows)

    dealt = segments_.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    return dealt.mapInPandas(run, f"anchor long, d1 long, d2 int, cover {_COVER}, groups array<struct<c1: long, c2: long, windows: array<struct<w1: long, w2: long, at: int, size: int>>>>")


def _merged_shards(windows: DataFrame) -> DataFrame:
    """Of distinct windows per shard (anchor, d1, d2, w1, w2, at, size): those that another shard of the same hash holds too."""

    names = ["anchor", "w1", "w2", "size"]

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        """Rows whose window occurs more than once; the frame is sorted, so each is found by bisection."""
        change = (frame[names] != frame[names].shift()).any(axis=1).to_numpy()
        number = np.cumsum(change)
        again = np.searchsorted(number, number, side="right") - np.searchsorted(number, number, side="left") > 1
        return frame.loc[again, ["anchor", "d1", "d2", "at", "size"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last window's rows, which the next batch may go on with: one for each shard at most
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(frame):
                continue
            last = (frame[names] == frame[names].iloc[-1]).all(axis=1).to_numpy()
            rest = frame[last]
            yield met(frame[~last])
        if rest is not None:
            yield met(rest)

    return windows.repartition("anchor", "w1").sortWithinPartitions(*names).mapInPandas(run, "anchor long, d1 long, d2 int, at int, size int")


def _spans(cover: list, size: int, n: int) -> list[list[int]]:
    """Begin and end of each maximal run of bytes in a text of ``n`` that windows of ``size`` bytes cover."""
    spans = []
    for lo, hi in sorted((c["lo"], min(c["hi"] + size, n)) for c in cover if c["size"] == size and c["lo"] + size <= n):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    return spans


def remove_repeated_substrings(docs: DataFrame, length: int = LENGTH, kmer: int = KMER, shard: int = SHARD, passage: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (start, length of each maximal removed run), kept (binary).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another;
    overlapping occurrences count and all are judged on the input. Texts are UTF-8 bytes, null is empty; texts shorter
    than ``length`` stay. Rows that repeat a text lose all of it if it is long enough, also under a null doc_id.
    An empty table gives an empty result.

    With ``passage``, a number of bytes between ``kmer`` and ``length``, a column ``repeated`` gives the spans that strings
    of that many bytes cover in the same sense. They are reported only: ``spans`` and ``kept`` are the same without it.
    """
    least = length if passage is None else passage
    if not kmer <= least <= length:
        raise ValueError("kmer, passage and length have to be in this order, the least first")
    lengths = sorted({least, length})
    keyed = _keyed(docs)
    folder = free_folder(docs.sparkSession, "table")
    found = written(_segments(keyed, least, length, kmer), folder)
    same = ["anchor", "d1", "d2"]
    # counts are combined in the tasks that read them and cut off from the joins, so that Spark can split a hot hash there
    hashes = cut_lineage(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("total"), F.min("d1").alias("d_low"), F.max("d1").alias("d_high")).filter("total > 1").drop("total"))
    shared = cut_lineage(found.join(hashes, "anchor").select(*same, "id", "mark", "first", "n", "anchor_at", (F.col("d_low") != F.col("d_high")).alias("mixed")))
    drop_folder(docs.sparkSession, folder)
    variants = shared.groupBy(*same, "mixed").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("id", "mark", "first", "n", "anchor_at")])
    whole = variants.filter("copies > 1").select(*same, F.array(*[F.struct(F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"), F.lit(x).alias("size")) for x in lengths]).alias("cover"))

    many = cut_lineage(variants.filter("mixed").groupBy("anchor").agg(F.count(F.lit(1)).alias("members"), F.min("copies").alias("fewest")).filter("fewest = 1").drop("fewest"))
    sorted_in = variants.filter("mixed").join(many, "anchor")
    wanted = sorted_in.groupBy("id", "mark").agg(F.collect_set(F.struct(*same, "first", "n", "anchor_at", "members")).alias("cuts"))  # bounded by the text
    texts = keyed.select("id", "mark", "doc_id", "text")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                rows = []
                for text, cuts in zip(batch["text"].iloc[at : at + 200], batch["cuts"].iloc[at : at + 200], strict=True):
                    body = text.encode()
                    for c in cuts:
                        pieces = -(-c["members"] // shard)
                        rows.append((c["anchor"], c["d1"], c["d2"], (c["d1"] ^ c["d2"]) % pieces, pieces > 1, c["n"], c["anchor_at"], body[c["first"] : c["first"] + c["n"] + length - 1]))
                if rows:
                    yield pd.DataFrame(rows, columns=["anchor", "d1", "d2", "shard", "split", "n", "anchor_at", "body"])

    bodies = texts.join(wanted, ["id", "mark"]).select("text", "cuts").mapInPandas(extract, "anchor long, d1 long, d2 int, shard long, split boolean, n int, anchor_at int, body binary")
    shards = cut_lineage(_sorted_shards(bodies, lengths))  # read twice
    inside = shards.filter(F.size("cover") > 0).select(*same, "cover")
    core = ["anchor", "c1", "c2"]
    groups = shards.select(*same, F.explode("groups").alias("g")).select(*same, "g.*")
    asked = groups.groupBy(*core).agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select(*core)
    across = _merged_shards(groups.join(asked, core).select(*same, F.explode("windows").alias("w")).select(*same, "w.*"))
    across = across.groupBy(*same).agg(F.collect_list(F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"), "size")).alias("cover"))  # at most a segment's windows
    covers = whole.unionByName(inside).unionByName(across)

    marked = shared.join(covers, same).select("id", "mark", F.transform("cover", lambda x: F.struct((F.col("first") + x.lo).alias("lo"), (F.col("first") + x.hi).alias("hi"), x.size.alias("size"))).alias("cover"))
    gone = marked.groupBy("id", "mark").agg(F.flatten(F.collect_set("cover")).alias("cover"))  # bounded by the text, however often it is repeated

    @F.pandas_udf("n_bytes long, spans array<struct<start: long, length: long>>, kept binary, repeated array<struct<start: long, length: long>>")
    def cut(texts: pd.Series, covers: pd.Series) -> pd.DataFrame:
        out = []
        for text, cover in zip(texts, covers, strict=True):
            body = text.encode()
            if cover is None or not len(cover):
                out.append((len(body), [], body, []))
                continue
            spans, repeated = _spans(cover, length, len(body)), _spans(cover, least, len(body))
            edges = [0, *(e for s in spans for e in s), len(body)]
            kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((len(body), [{"start": a, "length": b - a} for a, b in spans], kept, [{"start": a, "length": b - a} for a, b in repeated]))
        return pd.DataFrame(out, columns=["n_bytes", "spans", "kept", "repeated"])

    done = texts.join(gone, ["id", "mark"], "left").select("doc_id", cut("text", "cover").alias("r"))
    return done.select("doc_id", "r.n_bytes", "r.spans", "r.kept", *([] if passage is None else ["r.repeated"]))


def substring_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``remove_repeated_substrings``, and n_repeated.

    One row per input row, repeated rows and null ids included. A null or empty text has no bytes and the digest of
    nothing; so has a text that is removed whole. n_repeated counts the bytes that strings of PASSAGE bytes cover which
    start elsewhere too, those that stay included. Other columns are not read. An empty table gives an empty result.
    """
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.length)
    return remove_repeated_substrings(docs, passage=PASSAGE).select(
        "doc_id",
        "n_bytes",
        total("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        total("repeated").alias("n_repeated"),
    )

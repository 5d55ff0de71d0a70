"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

A byte-level tokenizer (A) and a piece tokenizer (B) cut the same bytes. Offsets where both end cut a text into groups,
and all tokens of A and B in a group are linked. Every linked pair of ids has a postings list: bitmaps of the documents
that hold it, in blocks of 65,536, and bit planes of how often each of them links it. Bitmaps of one block are merged by
OR, their bits counted give the pair's documents, and the lists then hand each pair's score back to its documents.

Texts are cut at single spaces, where no token of either vocabulary reaches across; the distinct pieces of some million
characters are encoded once.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempo.llm.common import doc_texts, in_tasks, written
from tempo.llm.packing import _encoder

_AT_ONCE = 2_000_000  # characters whose distinct pieces are encoded together: what a worker holds grows with them
_HELD = 1_000_000  # postings that a task holds before it passes them on
_DENSE = 4096  # documents from which on a block is a bitmap instead of a list
_BLOCK = 1 << 16
_GROUP = 1 << 12  # pairs of one group from which on equal ones are counted before they are formed
POSTINGS = "pair long, block long, docs binary, planes array<binary>"
COUNTED = f"{POSTINGS}, n_docs long, n_links long"
DOCS = "doc_id long, place long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ODD_SPACES = re.compile(r" \s|^\s|\s$")
_SPLIT = re.compile(r"(?<=\S) (?=\S)")


class Numbers(dict):
    """Numbers of strings in the order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = found = len(self)
        return found


class Tokenizers:
    """Both vocabularies: ids of texts, bytes of ids and ids as text with each separator behind."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.path_a = path_a
        self.a, self.b = _encoder(path_a), SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b = np.array([len(x) for x in self.bytes_b])
        self.size_a = np.zeros(self.a.n_vocab, dtype=np.int64)
        for token in self.a.token_byte_values():
            self.size_a[self.a.encode_single_token(token)] = len(token)
        # no piece may reach over a single space: it is the first character of a piece or its only one
        self.cuts = all("▁" not in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.text = [np.array([f"{i}{end}" for i in range(max(len(pieces), self.a.n_vocab))], dtype=object) for end in ",|;\n"]

    @functools.cached_property
    def library(self):
        """Only texts that the encoder of A can't read need it."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path_a)
        library.encode_special_tokens = True
        return library

    def ids_a(self, text: str) -> list[int]:
        try:
            return self.a.encode_ordinary(text)
        except Exception:  # very long runs of one character class exhaust that library's pattern engine
            return self.library.encode(text, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        """The text between the single spaces where it may be cut."""
        if not self.cuts:
            return [text]
        return _SPLIT.split(text) if _ODD_SPACES.search(text) else text.split(" ")


@functools.lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


class Aligned:
    """Groups and linked pairs of texts, each read with a space before it; ``ok`` tells if both cut the same bytes."""

    def __init__(self, read: Tokenizers, texts: list[str]):
        raw = [t.encode() for t in texts]
        size = np.array([len(r) + 1 for r in raw])
        found_b = read.b.encode(texts, num_threads=1)
        b = np.array([i for ids in found_b for i in ids], dtype=np.int64)
        whole = b" ".join([b"", *raw])
        self.ok = np.ones(len(texts), dtype=bool)
        if b"".join(map(read.bytes_b.__getitem__, b.tolist())) != whole:
            for i, (r, ids) in enumerate(zip(raw, found_b, strict=True)):
                self.ok[i] = b"".join(map(read.bytes_b.__getitem__, ids)) == b" " + r
            texts, size = [t for t, ok in zip(texts, self.ok, strict=True) if ok], size[self.ok]
            b = np.array([i for ids, ok in zip(found_b, self.ok, strict=True) if ok for i in ids], dtype=np.int64)
        a = self._ids_a(read, texts)
        end_a, end_b, end = np.cumsum(read.size_a[a]), np.cumsum(read.size_b[b]), np.cumsum(size)
        at = np.minimum(np.searchsorted(end_b, end_a), max(0, len(end_b) - 1))
        common = end_a[end_b[at] == end_a] if len(b) else end_a[:0]
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        owner = np.searchsorted(end, common)  # the text of each group
        count = lambda x: self._spread(np.bincount(owner, weights=x, minlength=len(texts)).astype(np.int64))
        self.n_a, self.n_b, self.n_groups, self.n_links = count(n_a), count(n_b), count(np.ones(len(common))), count(n_a * n_b)
        self._pairs(a, b, n_a, n_b, owner, len(texts))
        self._texts(read, a, b, group_a, group_b, n_a, n_b, owner)

    def _ids_a(self, read: Tokenizers, texts: list[str]) -> np.ndarray:
        """Texts are cut where tokens end, so they are encoded side by side; long ones alone."""
        if not read.cuts:
            return np.array([i for t in texts for i in read.ids_a(" " + t)], dtype=np.int64)
        parts, begin, held = [], 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= 200_000 or i + 1 == len(texts) or not _plain_ends(text, texts[i + 1]):
                parts += read.ids_a(" " + " ".join(texts[begin : i + 1]))
                begin, held = i + 1, 0
        return np.array(parts, dtype=np.int64)

    def _spread(self, values: np.ndarray) -> np.ndarray:
        """Values of the texts that are right, 0 for the others."""
        out = np.zeros(len(self.ok), dtype=np.int64)
        out[self.ok] = values
        return out

    def _pairs(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, owner: np.ndarray, texts: int) -> None:
        """pair (A id in the upper, B id in the lower 32 bits), times and start per text."""
        begin_a, begin_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        many = n_a * n_b
        small = np.flatnonzero(many <= _GROUP)
        n = many[small]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(n_b[small], n)
        pair = (a[np.repeat(begin_a[small], n) + at // np.maximum(wide, 1)] << 32) | b[np.repeat(begin_b[small], n) + at % np.maximum(wide, 1)]
        pairs, times, owners = [pair], [np.ones(len(pair), dtype=np.int64)], [np.repeat(owner[small], n)]
        for g in np.flatnonzero(many > _GROUP):  # equal ids of a long group are counted, so its pairs are distinct ones
            ids_a, times_a = np.unique(a[begin_a[g] : begin_a[g] + n_a[g]], return_counts=True)
            ids_b, times_b = np.unique(b[begin_b[g] : begin_b[g] + n_b[g]], return_counts=True)
            pairs.append(((ids_a[:, None] << 32) | ids_b[None, :]).ravel())
            times.append((times_a[:, None] * times_b[None, :]).ravel())
            owners.append(np.full(len(pairs[-1]), owner[g]))
        owners, pairs, times = map(np.concatenate, (owners, pairs, times))
        if len(many) > len(small):
            order = np.argsort(owners, kind="stable")
            owners, pairs, times = owners[order], pairs[order], times[order]
        self.pair, self.times = pairs, times
        self.pairs = self._spread(np.bincount(owners, minlength=texts))
        self.start = np.cumsum(self.pairs) - self.pairs

    def _texts(self, read: Tokenizers, a, b, group_a, group_b, n_a, n_b, owner) -> None:
        """``written``: the groups of each text as a1,a2|b1;a3|b2,b3; empty for texts that are not right."""
        parts = np.empty(len(a) + len(b), dtype=object)
        upto_a, upto_b = np.cumsum(n_a), np.cumsum(n_b)
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[upto_a - 1] = 1
        closes = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, dtype=bool)
        last_b[upto_b - 1] = np.where(closes, 3, 2)
        for ids, last, place in ((a, last_a, np.arange(len(a)) + (upto_b - n_b)[group_a]), (b, last_b, np.arange(len(b)) + upto_a[group_b])):
            for end in range(4):
                here = last == end
                parts[place[here]] = read.text[end][ids[here]]
        found = iter("".join(parts.tolist()).split("\n"))
        self.written = [next(found) if ok else "" for ok in self.ok]


def _plain_ends(before: str, after: str) -> bool:
    """Whether two texts may stand side by side with a space between them and keep their tokens."""
    return bool(before and after and not before[-1].isspace() and not after[0].isspace())


def align(read: Tokenizers, texts: list[str]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Per text n_a, n_b, n_groups and n_links, its groups' SHA-256, and (text, pair, links) of its distinct linked pairs.

    Texts that are empty or whose tokens do not give back their bytes have zeros, no digest and no pairs.
    """
    numbers = Numbers()
    used = [np.fromiter(map(numbers.__getitem__, read.pieces(t)), dtype=np.int64) if t else np.zeros(0, dtype=np.int64) for t in texts]
    found = Aligned(read, list(numbers))
    owner = np.repeat(np.arange(len(texts)), [len(u) for u in used])
    flat = np.concatenate([*used, np.zeros(0, dtype=np.int64)])
    wrong = np.zeros(len(texts), dtype=bool)
    wrong[owner[~found.ok[flat]]] = True
    counts = {c: np.bincount(owner, weights=getattr(found, c)[flat], minlength=len(texts)).astype(np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    digests = ["" if bad or not len(u) else hashlib.sha256(";".join(map(found.written.__getitem__, u.tolist())).encode()).hexdigest() for u, bad in zip(used, wrong.tolist(), strict=True)]
    for c in counts.values():
        c[wrong] = 0
    # distinct pieces of each text, then their pairs, then distinct pairs of each text
    key = np.sort(owner[~wrong[owner]] * len(numbers) + flat[~wrong[owner]])
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    often = np.diff(np.append(first, len(key)))
    text, piece = np.divmod(key[first], max(1, len(numbers)))
    n = found.pairs[piece]
    at = np.repeat(found.start[piece] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    ids, local = np.unique(found.pair, return_inverse=True)  # few, so pairs of a text sort by small numbers
    key = np.repeat(text, n) * max(1, len(ids)) + local[at]
    links = found.times[at] * np.repeat(often, n)
    order = np.argsort(key)
    key, links = key[order], links[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    text, pair = np.divmod(key[first], max(1, len(ids)))
    return counts, digests, text, ids[pair], np.add.reduceat(links, first) if len(first) else links


def binaries(numbers: np.ndarray, size: np.ndarray) -> pa.Array:
    """Ascending numbers below 65,536, ``size`` of each block, as blocks of bytes: a list of 16-bit numbers, or a bitmap."""
    dense = np.flatnonzero(size >= _DENSE)
    flat, width = numbers.astype("<u2").view(np.uint8), 2 * size
    if len(dense):
        begin, parts, done = np.cumsum(size) - size, [], 0
        for g in dense.tolist():
            bits = np.zeros(_BLOCK, dtype=np.uint8)
            bits[numbers[begin[g] : begin[g] + size[g]]] = 1
            parts += [flat[2 * done : 2 * begin[g]], np.packbits(bits, bitorder="little")]
            done = begin[g] + size[g]
        flat = np.concatenate([*parts, flat[2 * done :]])
        width[dense] = _BLOCK // 8
    offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])


def unpacked(blocks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``binaries`` and how many each block has; a bitmap's are counted by its bits."""
    if not len(blocks):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, offsets, data = blocks.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32, count=len(blocks) + 1, offset=4 * blocks.offset)
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    width = np.diff(offsets)
    dense = np.flatnonzero(width == _BLOCK // 8)
    if not len(dense):
        return np.frombuffer(flat.tobytes(), dtype="<u2").astype(np.int64), width // 2
    size, parts, done, begin = width // 2, [], 0, offsets[:-1] - offsets[0]
    for g in dense.tolist():
        bitmap = flat[begin[g] : begin[g] + _BLOCK // 8]
        size[g] = int(np.bitwise_count(bitmap).sum())
        parts += [np.frombuffer(flat[done : begin[g]].tobytes(), dtype="<u2"), np.flatnonzero(np.unpackbits(bitmap, bitorder="little"))]
        done = begin[g] + _BLOCK // 8
    parts.append(np.frombuffer(flat[done:].tobytes(), dtype="<u2"))
    return np.concatenate(parts).astype(np.int64), size


def posting_batch(pair: np.ndarray, block: np.ndarray, doc: np.ndarray, links: np.ndarray) -> dict[str, pa.Array]:
    """POSTINGS of rows sorted by pair, block and document. Plane k holds bit k of links - 1, so most lists have none."""
    first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (block[1:] != block[:-1]))) if len(pair) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(first, len(pair)))
    more = links - 1
    depth = np.frexp(np.maximum.reduceat(more, first).astype(float))[1].astype(np.int64) if len(first) else size  # planes that each list needs
    row = np.repeat(np.arange(len(first)), size)
    levels = int(depth.max(initial=0))
    before = np.cumsum(depth) - depth
    slots, numbers = [], []
    for k in range(levels):
        has = np.flatnonzero((more >> k) & 1)
        slots.append(before[row[has]] + k)
        numbers.append(doc[has])
    slot, number = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]) for x in (slots, numbers))
    order = np.argsort(slot, kind="stable")
    planes = binaries(number[order], np.bincount(slot, minlength=int(depth.sum())))
    offsets = pa.array(np.concatenate([[0], np.cumsum(depth)]).astype(np.int32))
    return {"pair": pa.array(pair[first]), "block": pa.array(block[first]), "docs": binaries(doc, size), "planes": pa.ListArray.from_arrays(offsets, planes)}


def posting_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The (row, block, document, links) that POSTINGS rows hold."""
    doc, size = unpacked(batch["docs"])
    row = np.repeat(np.arange(len(size)), size)
    block = batch["block"].to_numpy()[row]
    links = np.ones(len(doc), dtype=np.int64)
    planes = batch["planes"]
    if len(found := planes.flatten()):
        number, many = unpacked(found)
        depth = np.diff(planes.offsets.to_numpy())
        level = np.arange(len(many)) - np.repeat(np.cumsum(depth) - depth, depth)
        owner = np.repeat(np.arange(len(depth)), depth)
        # documents of a list ascend, so row and number find each one's place
        at = np.searchsorted(row * _BLOCK + doc, np.repeat(owner, many) * _BLOCK + number)
        np.add.at(links, at, np.repeat(np.left_shift(1, level), many))
    return row, block, doc, links


def encoded(docs: DataFrame, path_a: str, path_b: str, held: int = _HELD) -> DataFrame:
    """Rows of DOCS (pair null) and of POSTINGS (pair set) of the documents that each task reads.

    A document's place is its task's number in the upper 31 bits and its row there; 65,536 places are a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, place = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 33
        kept, n = [], 0
        for batch in batches:
            texts = batch["text"].to_pylist()
            size = np.array([len(t) for t in texts])
            for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(np.cumsum(size) // _AT_ONCE)) + 1):
                counts, digests, text, pair, links = align(read, texts[rows[0] : rows[-1] + 1])
                at = np.arange(place, place + len(rows))
                place += len(rows)
                fields = {"doc_id": batch["doc_id"].slice(rows[0], len(rows)), "place": pa.array(at), **{c: pa.array(v) for c, v in counts.items()}, "groups_sha256": pa.array(digests, pa.string())}
                yield _row_batch(fields, len(rows))
                kept.append((pair, at[text], links))
                n += len(pair)
                if n >= held:
                    yield from _posting_batches(kept)
                    kept, n = [], 0
        if n:
            yield from _posting_batches(kept)

    return doc_texts(docs).mapInArrow(run, f"{DOCS}, {POSTINGS}")


_FIELDS = (("doc_id", pa.int64()), ("place", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("block", pa.int64()), ("docs", pa.binary()), ("planes", pa.list_(pa.binary())))


def _row_batch(fields: dict[str, pa.Array], rows: int) -> pa.RecordBatch:
    return pa.record_batch({name: fields[name] if name in fields else pa.nulls(rows, kind) for name, kind in _FIELDS})


def _posting_batches(kept: list[tuple[np.ndarray, ...]], rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    pair, place, links = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.lexsort((place, pair))
    pair, place, links = pair[order], place[order], links[order]
    begin = 0
    while begin < len(pair):
        end = begin + rows
        if end < len(pair):  # a pair's postings stay together
            end = int(np.searchsorted(pair, pair[end], "right"))
        part = slice(begin, end)
        fields = posting_batch(pair[part], place[part] >> 16, place[part] & (_BLOCK - 1), links[part])
        yield _row_batch(fields, len(fields["pair"]))
        begin = end


def merged(rows: DataFrame, counted: bool = False) -> DataFrame:
    """POSTINGS with one row per pair and block: bitmaps and planes of the same block are merged by OR.

    ``counted`` adds what ``with_popcounts`` adds, in the same Python worker: two steps would take two workers a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            pair, block = batch["pair"].to_numpy(), batch["block"].to_numpy()
            last = int(np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (block[1:] != block[:-1])))[-1])
            rest = batch.slice(last)  # the last list may go on
            if last:
                yield joined(batch.slice(0, last))
        if rest is not None:
            yield joined(rest)

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = pa.record_batch([pa.concat_arrays([c]) for c in batch.columns], names=batch.schema.names)
        row, block, doc, links = posting_rows(batch)
        pair = batch["pair"].to_numpy()[row]
        order = np.lexsort((doc, block, pair))
        return pa.record_batch(posting_batch(pair[order], block[order], doc[order], links[order]))

    dealt = in_tasks(rows.select("pair", "block", "docs", "planes"), "pair", "block").sortWithinPartitions("pair", "block")
    return dealt.mapInArrow(lambda batches: _popcounts(run(batches)), COUNTED) if counted else dealt.mapInArrow(run, POSTINGS)


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, _, _, links = posting_rows(batch)
        n = np.bincount(row, minlength=batch.num_rows)
        total = np.bincount(row, weights=links, minlength=batch.num_rows).astype(np.int64)
        yield pa.record_batch([*batch.columns, pa.array(n), pa.array(total)], names=[*batch.schema.names, "n_docs", "n_links"])


def with_popcounts(postings: DataFrame) -> DataFrame:
    """Adds n_docs and n_links of each row: its bitmap's bits, and those of the planes by their worth."""
    return postings.mapInArrow(_popcounts, COUNTED)


def pair_scores(postings: DataFrame) -> DataFrame:
    """pair, a_id, b_id, n_docs, n_links, best: if no pair of the same A id has more documents."""
    counts = postings.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    counts = counts.select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "n_docs", "n_links")
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a_id").select("pair", "a_id", "b_id", "n_docs", "n_links", (F.col("n_docs") == F.col("most")).alias("best"))


def returned(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """place, n_best, count_sum: each list adds its pair's score, times the links, to its documents' sums.

    Lists are dealt by their block, so a task adds up one block of documents after the other and returns each once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, np.zeros((3, _BLOCK), dtype=np.int64)
        for batch in batches:
            row, block, doc, links = posting_rows(batch)
            values = (np.where(batch["best"].to_numpy(zero_copy_only=False)[row], links, 0), batch["score"].to_numpy()[row] * links, links)
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
            for begin, end in zip(cuts, [*cuts[1:], len(block)], strict=True):
                if block[begin] != current:
                    if current is not None:
                        yield sent(current, sums)
                    current, sums = int(block[begin]), np.zeros((3, _BLOCK), dtype=np.int64)
                for total, value in zip(sums, values, strict=True):
                    np.add.at(total, doc[begin:end], value[begin:end])
        if current is not None:
            yield sent(current, sums)

    def sent(block: int, sums: np.ndarray) -> pa.RecordBatch:
        best, count, links = sums
        at = np.flatnonzero(links)
        return pa.record_batch({"place": pa.array((block << 16) + at), "n_best": pa.array(best[at]), "count_sum": pa.array(count[at])})

    scored = postings.select("pair", "block", "docs", "planes").join(scores.select("pair", F.col("n_docs").alias("score"), "best"), "pair").drop("pair")
    return in_tasks(scored, "block").sortWithinPartitions("block").mapInArrow(run, "place long, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: documents (DOCS), postings (POSTINGS, n_docs, n_links) and the scores of all pairs.

    A null or empty text, and one whose tokens do not give back its bytes with a space before it, has zeros, an empty
    digest and no pairs. Repeated rows are documents of their own, a null doc_id stays null, ties of the best count
    are all best, very long texts are read whole, other columns are not read. An empty table gives empty tables.
    """
    import public_tokenizers

    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    # rows of documents keep their own place among the postings while both are dealt out
    rows = written(encoded(docs, path_a, path_b))
    found = rows.filter("place is not null").select("doc_id", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    postings = written(merged(rows.filter("pair is not null"), counted=True))
    return found, postings, pair_scores(postings)


def alignment_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; nulls, ties and the rest as in ``align_tokenizers``."""
    found, postings, scores = align_tokenizers(docs)
    sums = returned(postings, scores)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.join(sums, "place", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")

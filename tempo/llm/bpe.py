"""Byte-pair encoding with a minimal acyclic transducer for frequent words.

The corpus's most frequent words are compiled, with the ids that the merges give them, into an automaton whose
equal suffixes are shared. Every arc carries the number of words that sort before its branch, so the sum along a path
numbers the word and finds its ids. The automaton is one block of bytes, broadcast and memory-mapped by the
workers, which walk it with all distinct words of a batch at once; words outside it are merged by the ranked merges,
which gives the same ids.
"""

from __future__ import annotations

import functools
import heapq
import json
import mmap
import re
import struct
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempo.llm.common import doc_texts, written

LEXICON = 50_000  # frequent words that are compiled
_CACHE = 400_000  # merged words that a worker remembers: two workers with 900,000 each exceed 3 GB
_COUNTED = 200_000
_SHORT = 40  # bytes of a word that is merged together with others
_MERGED = 20_000  # words that are merged by the same arrays
_AT_ONCE = 4_000_000  # characters whose distinct words are walked through the automaton together
# Texts of these characters are normalised and split here; any other goes through the tokenizer file's own rules.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


class Lexicon:
    """Words' numbers and ids by walking the automaton; ``data`` is what ``compile_lexicon`` made, or a map of it."""

    def __init__(self, data):
        nodes, arcs, words, ids = struct.unpack_from("<4q", data, 0)
        at, parts = 32, []
        for n in (nodes + 1, nodes, arcs, arcs, words + 1, ids):
            parts.append(np.frombuffer(data, dtype="<i4", count=n, offset=at))
            at += 4 * n
        first, self.final, self.target, self.skip, self.start, self.ids = parts
        labels = np.frombuffer(data, dtype=np.uint8, count=arcs, offset=at)
        self.arcs = np.repeat(np.arange(nodes, dtype=np.int64) << 8, np.diff(first)) | labels  # ascending: node, then label

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that the automaton does not accept."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        node, number = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        out = np.full(len(words), -1, dtype=np.int64)
        live, step = np.arange(len(words)), 0
        while len(live):
            done = size[live] == step
            ended = live[done]
            ended = ended[self.final[node[ended]] != 0]
            out[ended] = number[ended]
            live = live[~done]
            wanted = (node[live] << 8) | flat[begin[live] + step]
            arc = np.minimum(np.searchsorted(self.arcs, wanted), max(0, len(self.arcs) - 1))
            known = self.arcs[arc] == wanted if len(self.arcs) else np.zeros(len(live), dtype=bool)
            live, arc = live[known], arc[known]
            number[live] += self.skip[arc]
            node[live] = self.target[arc]
            step += 1
        return out

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.start[number] : self.start[number + 1]]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic automaton of the words, built in sorted order; each finished suffix is merged with an equal one."""
    ordered = sorted(words)
    nodes: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    size: list[int] = []  # words below a node
    known: dict = {}

    def finish(node) -> int:
        shape = (node[0], tuple(node[1]))
        if shape not in known:
            known[shape] = len(nodes)
            nodes.append(shape)
            size.append(shape[0] + sum(size[t] for _, t in shape[1]))
        return known[shape]

    path = [[False, []]]
    last = b""
    for word in ordered:
        same = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        for i in range(len(last), same, -1):
            done = finish(path.pop())
            path[-1][1].append((last[i - 1], done))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    for i in range(len(last), 0, -1):
        done = finish(path.pop())
        path[-1][1].append((last[i - 1], done))
    root = finish(path.pop())
    order = [root, *(n for n in range(len(nodes)) if n != root)]
    place = {n: i for i, n in enumerate(order)}
    first, final, target, skip, labels = [0], [], [], [], bytearray()
    for n in order:
        accepts, arcs = nodes[n]
        final.append(int(accepts))
        before = int(accepts)
        for label, t in arcs:
            labels.append(label)
            target.append(place[t])
            skip.append(before)
            before += size[t]
        first.append(len(labels))
    start, ids = [0], []
    for word in ordered:
        ids += words[word]
        start.append(len(ids))
    body = b"".join(np.array(x, dtype="<i4").tobytes() for x in (first, final, target, skip, start, ids))
    return struct.pack("<4q", len(nodes), len(labels), len(ordered), len(ids)) + body + bytes(labels)


class Tokenizer:
    """What a tokenizers file says: vocabulary, ranked merges, special tokens; encodes words and joins ids to text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.ids, self.suffix = path, model["vocab"], model.get("end_of_word_suffix") or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ", 1)): rank for rank, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: the printable bytes, which stand for themselves
        moved = [b for b in range(256) if b not in kept]
        self.char = {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(moved)}
        self.byte = {c: b for b, c in self.char.items()}

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer as Library

        return Library.from_file(self.path)

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if _PLAIN.fullmatch(text):
            return _PIECES.findall(text.lower())
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.byte[c] for c in piece).decode("utf-8", "surrogateescape") for piece, _ in found]

    def segments(self, text: str) -> list[tuple[list[str], int | None]]:
        """Words up to each special token in the text, with that token's id; the last has none."""
        if self.split_special is None or "<|" not in text:
            return [(self.words(text), None)]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out.append((self.words(text[at : m.start()]), self.special[m[0]]))
            at = m.end()
        return [*out, (self.words(text[at:]), None)]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of lowest rank, leftmost first, is merged until none is left."""
        symbols: list = [self.char[b] for b in word]
        if not symbols:
            return []
        symbols[-1] += self.suffix
        ranks = self.ranks
        if len(symbols) > 48:
            return self._merge_long(symbols)
        worst = 1 << 60
        order = [ranks.get(pair, worst) for pair in zip(symbols, symbols[1:], strict=False)]
        while order and (best := min(order)) < worst:
            at = order.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del order[at]
            if at:
                order[at - 1] = ranks.get((symbols[at - 1], symbols[at]), worst)
            if at < len(order):
                order[at] = ranks.get((symbols[at], symbols[at + 1]), worst)
        return [self.ids[s] for s in symbols]

    @functools.cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the pairs that merge, their ranks and what they merge to; the ids of bytes, of last ones after 256."""
        wide = len(self.ids)
        rows = sorted((self.ids[a] * wide + self.ids[b], rank, self.ids[a + b]) for (a, b), rank in self.ranks.items())
        key, rank, made = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True))
        return key, rank, made, np.array([self.ids[self.char[b] + end] for end in ("", self.suffix) for b in range(256)], dtype=np.int64)

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """``merge`` of many words at once: in every round each word's pair of lowest rank, leftmost first, is merged."""
        out: list = [None] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= _SHORT]
        for i, w in enumerate(words):
            if not 0 < len(w) <= _SHORT:
                out[i] = np.array(self.merge(w), dtype=np.int32)
        if not short:
            return out
        keys, ranks, made, first = self._pairs
        wide, none = len(self.ids), len(self.ranks)
        size = np.array([len(words[i]) for i in short])
        symbol = np.frombuffer(b"".join(words[i] for i in short), dtype=np.uint8).astype(np.int64)
        symbol[np.cumsum(size) - 1] += 256
        symbol = first[symbol]
        word = np.repeat(np.array(short), size)
        while len(symbol):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            pair = np.append(symbol[:-1] * wide + symbol[1:], -1)
            pair[np.append(begin[1:], len(word)) - 1] = -1  # no pair across words
            at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
            rank = np.where(keys[at] == pair, ranks[at], none)
            best = np.minimum.reduceat(rank * len(word) + np.arange(len(word)), begin)  # lowest rank, then leftmost
            merges = best // len(word) < none
            if not merges.all():
                for a, b, done in zip(begin.tolist(), [*begin[1:].tolist(), len(word)], (~merges).tolist(), strict=True):
                    if done:
                        out[word[a]] = symbol[a:b].astype(np.int32)
            place = best[merges] % len(word)
            symbol[place] = made[at[place]]
            keep = np.repeat(merges, np.diff(np.append(begin, len(word))))
            keep[place + 1] = False
            symbol, word = symbol[keep], word[keep]
        return out

    def _merge_long(self, symbols: list) -> list[int]:
        """The same over a linked list and a heap, for words where rescanning would cost the square of the length."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        end, ranks = len(symbols), self.ranks
        queue = [(ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if symbols[i] is None or j >= end or (symbols[i], symbols[j]) != pair:
                continue
            symbols[i], symbols[j] = symbols[i] + symbols[j], None
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
                if (p := (symbols[i], symbols[after[i]])) in ranks:
                    heapq.heappush(queue, (ranks[p], i, p))
            if before[i] >= 0 and (p := (symbols[before[i]], symbols[i])) in ranks:
                heapq.heappush(queue, (ranks[p], before[i], p))
        return [self.ids[s] for s in symbols if s is not None]

    def decode(self, ids) -> str:
        return " ".join([self.pieces[int(i)] for i in ids])


@functools.lru_cache(maxsize=2)
def _merged_words(tokenizer: Tokenizer) -> dict[str, tuple[bytes, str]]:
    """What a worker has merged outlives a task; only words that the automaton does not accept get here."""
    return {}


class Numbers(dict):
    """Numbers of strings in the order of their first use."""

    def __missing__(self, key: str) -> int:
        self[key] = found = len(self)
        return found


class Encoder:
    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon):
        self.tokenizer, self.lexicon, self.merged = tokenizer, lexicon, _merged_words(tokenizer)
        self.frequent: dict[int, tuple[bytes, str]] = {}  # by number: as many as the automaton has words

    def _frequent(self, number: int) -> tuple[bytes, str]:
        if number not in self.frequent:
            ids = self.lexicon.ids_of(number)
            self.frequent[number] = (ids.tobytes(), self.tokenizer.decode(ids))
        return self.frequent[number]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """The ids of each text and the text they decode to."""
        known, parts = Numbers(), []
        for text in texts:  # places of words instead of a string for every occurrence
            parts.append([(list(map(known.__getitem__, found)), special) for found, special in self.tokenizer.segments(text)])
        words = list(known)
        numbers = self.lexicon.numbers([w.encode("utf-8", "surrogateescape") for w in words]).tolist()
        ids_of, text_of, unseen = [b""] * len(words), [""] * len(words), []
        for i, (w, n) in enumerate(zip(words, numbers, strict=True)):
            if n >= 0:
                ids_of[i], text_of[i] = self._frequent(n)
            elif w in self.merged:
                ids_of[i], text_of[i] = self.merged[w]
            else:
                unseen.append(i)
        for at in range(0, len(unseen), _MERGED):  # arrays of some symbols of each word stay small
            part = unseen[at : at + _MERGED]
            for i, found in zip(part, self.tokenizer.merge_many([words[i].encode("utf-8", "surrogateescape") for i in part]), strict=True):
                ids_of[i], text_of[i] = value = (found.tobytes(), self.tokenizer.decode(found.tolist()))
                if len(self.merged) < _CACHE:
                    self.merged[words[i]] = value
        out = []
        for segments in parts:
            ids, decoded = [], []
            for found, special in segments:
                ids.append(b"".join(map(ids_of.__getitem__, found)))
                if found:
                    decoded.append(" ".join(map(text_of.__getitem__, found)))
                if special is not None:
                    ids.append(array("i", [special]).tobytes())
                    decoded.append(self.tokenizer.decode([special]))
            out.append((np.frombuffer(b"".join(ids), dtype=np.int32), " ".join(decoded)))
        return out


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def frequent_words(docs: DataFrame, path: str, size: int) -> list[str]:
    """The ``size`` most frequent words of those that occur twice, counted over all texts; ties go to the smaller word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, seen = tokenizer(path), Counter()
        for batch in batches:
            for text in batch["text"]:
                for words, _ in read.segments(text):
                    seen.update(words)
                if len(seen) > _COUNTED:
                    yield pd.DataFrame({"word": [w.encode("utf-8", "surrogateescape") for w in seen], "n": list(seen.values())})
                    seen = Counter()
        if seen:  # an empty frame would have no types
            yield pd.DataFrame({"word": [w.encode("utf-8", "surrogateescape") for w in seen], "n": list(seen.values())})

    counted = written(doc_texts(docs).mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"))
    # how many words have which power of 2 ** (1 / 8) as their count tells from which count on they are wanted, so few are sorted
    power = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, 0
    for r in counted.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("power")).collect():  # at most 8 * 63 rows
        least, held = r["power"], held + r["words"]
        if held >= size:
            break
    most = counted.filter(power >= least).orderBy(F.desc("n"), "word").limit(size).filter("n > 0")  # the filter has the executors merge the tasks' lists
    return [bytes(r["word"]) for r in most.collect()]  # bounded by size


def encode(docs: DataFrame, tokenizer_path: str | None = None, lexicon_size: int = LEXICON) -> DataFrame:
    """One row per input row: doc_id, ids (array<int>), decoded (the text that the ids stand for).

    Ids are those of the tokenizers library without added special tokens; special tokens written in a text count as
    such, as they do there. A null or empty text has no ids and decodes to the empty text. Repeated rows each give a
    row; a null doc_id stays null; a very long text is encoded whole; words of equal count enter the lexicon by name. An
    empty table gives an empty result.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    read = tokenizer(tokenizer_path)
    words = frequent_words(docs, tokenizer_path, lexicon_size) if lexicon_size else []
    shared = docs.sparkSession.sparkContext.broadcast(compile_lexicon({w: read.merge(w) for w in words}))  # as many words as asked for

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with tempfile.TemporaryFile() as file:
            file.write(shared.value)
            file.flush()
            encoder = Encoder(tokenizer(tokenizer_path), Lexicon(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)))
            for batch in batches:
                cuts = np.flatnonzero(np.diff(batch["text"].str.len().cumsum() // _AT_ONCE)) + 1
                for rows in np.split(np.arange(len(batch)), cuts):
                    part = batch.iloc[rows]
                    found = encoder.encode(part["text"].tolist())
                    yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "ids": [f[0] for f in found], "decoded": [f[1] for f in found]})

    return doc_texts(docs).mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode``.

    A null or empty text has 0 tokens and the digests of nothing; repeated rows, null ids and empty tables as in
    ``encode``. Other columns are not read.
    """
    return encode(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

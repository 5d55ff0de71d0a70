"""Packing tokenized documents into training windows by the sum-of-squares rule.

Every task packs the rows of its own input split, so nothing is shuffled and a lost task is simply run again.
Inside a task an array counts the open windows by fill level; each document's remainder goes to the level that
keeps the sum of squared counts smallest. At the end the emptiest open windows are taken apart to fill up the fullest,
which stay as the rule made them; the last remainder is cut into powers of two. So nothing needs padding.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempo.llm.common import doc_texts

WINDOW = 2048
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    """The byte-level BPE of a tokenizers file as ranks: for that kind of vocabulary an id is its merge's rank."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: the printable bytes, which stand for themselves
    moved = [b for b in range(256) if b not in kept]
    byte_of = {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(moved)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str, path: str, end_id: int = END_ID) -> np.ndarray:
    """The ids of one text, then ``end_id``, as little-endian unsigned 32-bit numbers."""
    encoder = _encoder(path)
    try:
        ids = encoder.encode(text, allowed_special="all") if "<|" in text else encoder.encode_ordinary(text)
    except Exception:  # very long runs of one character class exhaust that library's pattern engine
        ids = _library(path).encode(text, add_special_tokens=False).ids
    return np.array([*ids, end_id], dtype="<u4")


class Packer:
    """Open windows of one task, by fill level."""

    def __init__(self, first_id: int, window: int = WINDOW):
        self.window, self.next_id = window, first_id
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}  # fill level: windows, each a list of (doc_id, start, ids, doc_tokens)
        self.rows: list[tuple] = []

    def level_for(self, size: int) -> int:
        """The fill level, 0 for a new window, whose choice adds least to the sum of squared counts."""
        n, w = self.count, self.window
        here = n[1 : w - size + 1]
        change = 2 * (n[size + 1 : w + 1] - here + 1)
        if len(change):
            change[-1] = 1 - 2 * here[-1]  # full windows are not counted
            change = np.where(here > 0, change, np.iinfo(np.int64).max)
            best = int(change.argmin())
            if change[best] <= 2 * n[size] + 1:
                return best + 1
        return 0

    def close(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        total, full = len(ids), len(ids) - len(ids) % self.window
        for start in range(0, full, self.window):
            self.close([(doc_id, start, ids[start : start + self.window], total)])
        if size := total - full:
            level = self.level_for(size)
            pieces = []
            if level:
                pieces = self.open[level].pop()
                self.count[level] -= 1
            pieces.append((doc_id, full, ids[full:].copy(), total))
            if (level := level + size) == self.window:
                self.close(pieces)
            else:
                self.open.setdefault(level, []).append(pieces)
                self.count[level] += 1

    def finish(self) -> None:
        """Fill up the fullest open windows with pieces of the emptiest ones; cut what is left into powers of two."""
        windows = [(level, pieces) for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        self.open, low, high = {}, 0, len(windows) - 1
        spare: list[tuple] = []  # pieces of the window that is being taken apart, the next one last
        while low <= high or spare:
            if low > high:  # the remainder of the last window
                level, pieces, rest = 0, [], sum(len(p[2]) for p in spare)
                goal = 1 << (rest.bit_length() - 1)
            else:
                (level, pieces), goal = windows[low], self.window
                low += 1
            while level < goal:
                if not spare:
                    if low > high:
                        break
                    spare = windows[high][1][::-1]
                    high -= 1
                doc_id, start, ids, total = spare.pop()
                part, ids = ids[: goal - level], ids[goal - level :]
                pieces.append((doc_id, start, part, total))
                level += len(part)
                if len(ids):
                    spare.append((doc_id, start + len(part), ids, total))
            if level == goal:
                self.close(pieces)
            else:  # nothing is left to fill it up with
                spare = pieces[::-1]

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        return frame.astype({c: "int64" for c in frame.columns if c not in ("doc_id", "ids")}).astype({"doc_id": "Int64"})


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur; a null doc_id stays
    null. Texts longer than a window are cut into full windows and a remainder. ``window`` has to be a power of two.
    Sequences are ``window`` long or, in the last few of a task, a power of two, so none needs padding. The ids of a
    task's sequences start at its partition number times 2**40. An empty table gives an empty result.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    if window < 1 or window & (window - 1):
        raise ValueError("window has to be a power of two")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                packer.add(None if pd.isna(doc_id) else int(doc_id), token_ids(text, tokenizer_path, end_id))
            if packer.rows:  # an empty frame would have no types
                yield packer.take()
        packer.finish()
        if packer.rows:
            yield packer.take()

    return doc_texts(docs).mapInPandas(run, SCHEMA)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of ``pack`` with a checksum in place of their ids.

    A null or empty text is one piece of one id; repeated rows, null ids and empty tables as in ``pack``. Other columns
    are not read.
    """
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

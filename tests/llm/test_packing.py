import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tempo.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, texts, window=packing.WINDOW):
    library = Tokenizer.from_file(PATH)
    docs, sequences = {}, {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    assert set(docs) == set(texts)
    for i, parts in docs.items():
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        parts.sort(key=lambda p: p.start)
        assert [p.start for p in parts] == list(np.cumsum([0, *[p.length for p in parts[:-1]]]))
        assert sum(p.length for p in parts) == len(ids) == parts[0].doc_tokens
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0, *[p.length for p in parts[:-1]]]))
        size = sum(p.length for p in parts)
        assert size <= window and size & (size - 1) == 0  # no padding is needed


def test_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(packing.packed_pieces(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_edges(spark, empty):
    texts = {1: None, 2: "", 3: "x " * 9000, 4: "<|endoftext|> a", 5: " " * 300_000, 6: "é日本"}
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in texts.items()], "doc_id long, text string, length int, start int")
    check(packing.packed_pieces(frame).collect(), texts)
    assert packing.packed_pieces(empty).count() == 0


def test_level_minimises_sum_of_squares():
    rng = np.random.default_rng(0)
    packer = packing.Packer(0, 16)
    for _ in range(300):
        size = int(rng.integers(1, 16))
        n = packer.count.copy()

        def cost(level, n=n, size=size):
            m = n.copy()
            if level:
                m[level] -= 1
            if level + size < 16:
                m[level + size] += 1
            return (m[1:16] ** 2).sum()

        options = [0, *[h for h in range(1, 17 - size) if n[h] > 0]]
        assert cost(packer.level_for(size)) == min(map(cost, options))
        packer.add(1, np.arange(size, dtype="<u4"))
    packer.finish()
    sizes = {}
    for row in packer.rows:
        sizes[row[5]] = sizes.get(row[5], 0) + row[2]
    assert sum(s != 16 for s in sizes.values()) <= 4


def test_most_pieces_stay_where_the_rule_put_them():
    rng = np.random.default_rng(2)
    packer = packing.Packer(0, 256)
    for doc_id in range(4000):
        packer.add(doc_id, np.arange(int(rng.integers(5, 200)), dtype="<u4"))
    total = sum(len(p[2]) for windows in packer.open.values() for w in windows for p in w) + sum(r[2] for r in packer.rows)
    packer.finish()
    assert sum(r[2] for r in packer.rows) == total
    whole = sum(r[2] for r in packer.rows if r[1] == 0 and r[2] == r[4])
    assert whole > 0.95 * total  # the others were cut to fill up windows


def test_window_has_to_be_a_power_of_two(awkward):
    with pytest.raises(ValueError):
        packing.pack(awkward, window=1000)

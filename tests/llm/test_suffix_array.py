import random
from collections import Counter

import pytest

from tempo.llm import suffix_array as S


def brute(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])), kept))
    return out


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        order, _, prefix, begin, _ = S.suffix_array(parts)
        suffix = {b + j: (p[j:], k) for k, (b, p) in enumerate(zip(begin, parts, strict=True)) for j in range(len(p))}
        want = sorted(suffix, key=lambda x: [*suffix[x][0], -1 - suffix[x][1]])
        assert list(order) == want
        for a, b in zip(want, want[1:], strict=False):
            x, y = suffix[a][0], suffix[b][0]
            assert prefix[b] == next((i for i, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))


@pytest.mark.parametrize(("length", "kmer", "shard"), [(20, 6, 2048), (12, 5, 2)])
def test_matches_brute_force(spark, length, kmer, shard):
    rng = random.Random(length)
    base = "".join(rng.choice("abcdé ") for _ in range(3 * length))
    texts = [None, "", base, base]
    for _ in range(40):
        k = rng.random()
        if k < 0.4:
            t = list(base)
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
        elif k < 0.5:
            texts.append("ab" * rng.randint(0, 2 * length))
        elif k < 0.7:
            texts.append("".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 3 * length))) + base[length // 2 : length // 2 + rng.randint(length - 2, 2 * length)] + "q")
        else:
            texts.append("".join(rng.choice("ab") for _ in range(rng.randint(0, 2 * length))))
    ids = [i if i % 7 else None for i in range(len(texts))]
    ids[5] = ids[4]
    frame = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), bytes(r.kept)) for r in S.remove_repeated_substrings(frame, length, kmer, shard).collect())
    assert got == Counter((i, *b) for i, b in zip(ids, brute([(t or "").encode() for t in texts], length), strict=True))


def test_least_doc_id_is_not_a_null_one(spark):
    """Ids at the end of their range, null ones and different texts under one id are told apart."""
    texts = ["a" * 30, "b" * 30 + "cd", "cd" * 20, "xyz" * 9 + "b" * 25]
    rows = [(i, t) for i in (None, -(2**63), 5) for t in texts[:2]] + [(5, texts[2]), (None, texts[3])]
    got = Counter((r.doc_id, bytes(r.kept)) for r in S.remove_repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 20, 6).collect())
    assert got == Counter((i, b[3]) for (i, _), b in zip(rows, brute([t.encode() for _, t in rows], 20), strict=True))


def test_repeated_rows_and_empty(awkward, empty):
    got = S.substring_digests(awkward)
    want = brute([(r.text or "").encode() for r in awkward.collect()], S.LENGTH)
    assert Counter((r.n_bytes, r.n_removed, r.n_spans) for r in got.collect()) == Counter(w[:3] for w in want)
    assert S.substring_digests(empty).count() == 0


@pytest.mark.parametrize("shard", [2048, 2])
def test_shorter_passages_are_reported_and_stay(spark, shard):
    """Repeats of 12 bytes are reported as brute force has them, within one text too; those of 20 go as without them."""
    rng = random.Random(shard)
    base = "".join(rng.choice("abcdé ") for _ in range(90))
    texts = [None, "", base, base, "ab" * 30, "a" * 45, "xab" * 4, base[:15], base[70:]]
    for _ in range(50):
        at, n = rng.randrange(60), rng.choice([11, 12, 13, 16, 19, 20, 21, 40])
        parts = ["".join(rng.choice("wxyz") for _ in range(rng.randint(0, 15))), base[at : at + n], "".join(rng.choice("wxyz") for _ in range(rng.randint(0, 15))), rng.choice(["", "ab" * 7, "aa" * 9])]
        rng.shuffle(parts)
        texts.append("".join(parts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), bytes(r.kept), sum(s.length for s in r.repeated), len(r.repeated)) for r in S.remove_repeated_substrings(frame, 20, 5, shard, 12).collect())
    bodies = [(t or "").encode() for t in texts]
    assert got == [(i, *long, *short[1:3]) for i, (long, short) in enumerate(zip(brute(bodies, 20), brute(bodies, 12), strict=True))]


def test_query_reports_passages_of_over_50_words(spark):
    """A passage of 55 words and under 400 bytes in two texts stays by the contract, and n_repeated tells of it."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(700)]
    passage = " ".join(words[:55])
    assert 256 <= len(passage) < S.LENGTH
    texts = [" ".join(words[100:200]) + "\n" + passage, passage + "! " + " ".join(words[200:300]), " ".join(words[300:700])]
    got = sorted(S.substring_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_removed", "n_repeated").collect())
    assert [tuple(r) for r in got] == [(0, 0, len(passage)), (1, 0, len(passage)), (2, 0, 0)]

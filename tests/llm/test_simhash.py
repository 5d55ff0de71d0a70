import random
import re
import time
from itertools import combinations

import numpy as np
import xxhash

from tempo.functions.storage import _FREE_SHUFFLES
from tempo.llm import components, simhash
from tempo.llm.common import cut_lineage, written
from tempo.llm.components import connected_components


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(nodes, edges):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return least


def test_awkward_rows_match_brute_force(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    fps = [plain_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i, j in combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    group = plain_components(range(len(rows)), edges)
    want = sorted(
        (str(i), f"{fps[k]:016x}", str(min((rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None), default=None))) for k, (i, _) in enumerate(rows)
    )
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_components(awkward).collect())
    assert got == want


def test_empty(empty):
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_links_equal_brute_force_for_sparse_and_crowded_cells(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(3):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = plain_components(signed, [(a, b) for a, b in combinations(signed, 2) if (a ^ b & (2**64 - 1)).bit_count() <= 2 or ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for crowd in (1, 4, 1000):
        edges = simhash.fingerprint_links(frame, crowd)
        pairs = [(r.a, r.b) for r in edges.collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in pairs)
        found = plain_components(signed, pairs)
        assert found == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 101), (100, 101)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_settled_components_take_no_round(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(components, "cut_lineage", lambda df: kept.append(df) or cut_lineage(df))
    edges = spark.createDataFrame([(1, 5), (6, 1), (2, 3), (3, 2), (4, 4)], "a long, b long")
    assert {r.node: r.root for r in components.connected_components(edges).collect()} == {1: 1, 5: 1, 6: 1, 2: 2, 3: 2}
    assert len(kept) == 1


def test_checkpoints_and_written_tables_free_their_shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles

    def shuffles() -> set[str]:
        found = files()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    counts = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    for keep in (cut_lineage, written):
        before, setting = shuffles(), spark.conf.get(_FREE_SHUFFLES)
        rows = keep(counts)  # counts is held, so no garbage collection can free what it ran
        assert spark.conf.get(_FREE_SHUFFLES) == setting
        end = time.time() + 20
        while (left := shuffles() - before) and time.time() < end:
            time.sleep(0.1)
        assert not left
        assert {r.k: r["count"] for r in rows.collect()} == {r.k: r["count"] for r in counts.collect()}


def test_near_duplicates_by_five_word_shingles(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(200)]
        for c in range(3):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(200)] = "edited"
            rows.append((10 * g + c, " ".join(copy)))
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(100))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10 * g + c: 10 * g for g in range(12) for c in range(3)}


def test_star_of_edited_copies_matches_brute_force(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for c in range(1, 401):  # copies are near the original and mostly not near each other
        copy = list(base)
        for k in rng.sample(range(0, 300, 6), 5):
            copy[k + 3] = f"edit{c}x{k}"
        rows.append((c, " ".join(copy)))
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    near = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert 400 <= len(near) < 20000
    assert len({i for pair in near for i in pair}) == 401
    want = plain_components(sets, near)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert got == want


def test_blocks_of_one_root_do_not_meet(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = []
    for g, own in enumerate((12, 70)):  # two groups that share most words, 0.6 alike
        text = [w if k % own else f"own{g}" for k, w in enumerate(base)]
        rows += [(100 * g + c, " ".join([*text, f"tail{g}x{c}"])) for c in range(40)]
    want = {100 * g + c: 100 * g for g in (0, 1) for c in range(40)}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8).collect()}
    assert got == want


def test_embedding_is_a_lower_bound():
    rng = random.Random(1)
    for _ in range(300):
        a, b = rng.getrandbits(64), rng.getrandbits(64)
        counts = lambda x: np.array([(x >> 2 * s & 3).bit_count() for s in range(32)])
        assert abs(counts(a) - counts(b)).sum() <= (a ^ b).bit_count()


def test_near_duplicates_of_a_whole_table_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text or "", 5).tolist()) for r in docs.collect()}
    ids = sorted(i for i, s in sets.items() if s)
    root = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    groups = {i: r for i, r in root.items() if i != r or sum(q == r for q in root.values()) > 1}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == groups

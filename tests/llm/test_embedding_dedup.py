import numpy as np

from tempo.llm import embedding_dedup as E


def brute(ids, vectors, threshold=0.95):
    x = np.array(vectors, dtype=np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(ids))
    while True:
        new = np.array([min([root[i], *root[near[i]]]) for i in range(len(ids))])
        if (new == root).all():
            break
        root = new
    return near, root


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 64))
    near = np.vstack([base[i % 60] + rng.normal(size=64) * 0.2 for i in range(300)])
    vectors = np.vstack([base, near, near[:5]]).astype(np.float32)
    rows = [(int(i), [float(v) for v in x], 1) for i, x in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.similar_vectors(frame).collect()}
    links, root = brute(range(len(vectors)), vectors)
    assert len(got) == len(vectors)
    assert sum(g[0] for g in got.values()) >= 0.98 * links.sum()
    assert all(g[0] <= links[i].sum() for i, g in got.items())
    assert np.mean([got[i][1] == root[i] for i in got]) > 0.98
    assert all(g[2] == (g[1] == i) for i, g in got.items())


def test_unusable_vectors_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (11, [2.0, -1.0])]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, cls int, n_links int")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in E.similar_vectors(frame).collect())
    want = [(str(i), 0, str(i), True) for i in (1, 2, 3, 4, 5, 6, 10, 11, None)] + [("7", 3, "7", True)] * 2 + [("8", 3, "7", False), ("9", 3, "7", False)]
    assert got == sorted(want)
    assert E.similar_vectors(frame.limit(0)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(E.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(E.hadamard(E.hadamard(x)), x)

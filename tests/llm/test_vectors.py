"""op10 against brute force: same links, counts and components."""

import math

import numpy as np

from tessella.llm import queries, vectors
from tessella.llm.components import components


def brute(ids, x, threshold=0.95):
    x = np.asarray(x, dtype=np.float64)
    n = np.linalg.norm(x, axis=1)
    s = (x @ x.T) / n[:, None] / n[None, :] >= threshold
    np.fill_diagonal(s, False)
    low = np.array(ids)
    while True:
        new = np.minimum(low, np.where(s, low[None, :], np.iinfo(np.int64).max).min(1))
        if (new == low).all():
            return {i: (int(c), int(r), bool(i == r)) for i, c, r in zip(ids, s.sum(1), low)}
        low = new


def run(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    assert run(queries.queries()["op10_embedding_neardup"](spark, sf_dir)) == want


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest ones: at least 0.9 are found (in fact nearly all)."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((600, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.951 * a + math.sqrt(1 - 0.951**2) * o
    x = np.concatenate([a, b, rng.standard_normal((3000, 64))])
    got = run(vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")))
    found = sum(got[i + 600][1] == i for i in range(600)) / 600
    assert found >= 0.98
    assert all(got[i][0] <= 1 for i in range(600))


def test_large_group_of_near_copies_is_counted_in_blocks(spark):
    rng = np.random.default_rng(6)
    c = rng.standard_normal(16)
    x = np.concatenate([c + 0.05 * rng.standard_normal((2600, 16)), np.repeat(c[None], 50, 0), rng.standard_normal((100, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert run(vectors.near_vectors(df)) == brute(range(len(x)), x)


def test_edges(spark):
    inf = float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, [float("nan"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (11, [1.0, 0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as label", "2 as vec", "3 as x")
    got = run(vectors.near_vectors(df))
    assert got == {1: (3, 1, True), 2: (3, 1, False), 10: (3, 1, False), 11: (3, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)}
    assert run(vectors.near_vectors(df.limit(0))) == {}


def test_norms_of_any_size(spark):
    """Links don't depend on lengths, from the least to the largest doubles; equal ids are vectors of their own."""
    rng = np.random.default_rng(9)
    a = rng.standard_normal((40, 8))
    x = np.concatenate([a, a + 0.05 * rng.standard_normal((40, 8))])
    want = brute(range(80), x)
    for scale in (1.0, 1e200, 1e-200, 1e300, 1e-300):
        df = spark.createDataFrame([(i, (v * (scale if i % 3 else 1.0)).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        assert run(vectors.near_vectors(df)) == want
    tiny = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e200, 1.001e200]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1e300, -1e-300])], "vec_id long, embedding array<double>")
    assert run(vectors.near_vectors(tiny)) == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 4: (3, 1, False), 5: (0, 5, True)}
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vectors.near_vectors(twice).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_components(spark):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 480)] + [(7, 7), (None, 3)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in e:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {a: find(a) for a in parent}

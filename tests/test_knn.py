"""Nearest neighbours and communities against brute force."""

import numpy as np

from tessella.operators import clustering as K
from tessella.operators import vectors as V
from tessella.plans import curriculum_queries  # noqa: F401
from tessella.plans.registry import QUERIES, Tables


def brute(ids, x, k):
    out = {}
    for i, v in zip(ids, x):
        d = np.round(np.sqrt(((x - v) ** 2).sum(1)), 9)
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [int(ids[j]) for j in order]
    return out


def test_blocks_give_the_exact_neighbours(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(120, 4)), np.ones((40, 4))]  # 40 equal ones: ties go to the least key
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    want = brute(np.arange(len(x)), x, 3)
    for blocks in ((16, 32), (1000, 1000)):
        got = {}
        for r in V.knn(df, df, "id", "v", 3, 4, *blocks).orderBy("src", "rank").collect():
            got.setdefault(r.src, []).append(r.dst)
        assert got == want
    assert V.knn(df.limit(0), df, "id", "v", 3, 4).count() == 0 and V.knn(df.limit(1), df.limit(1), "id", "v", 3, 4).count() == 0


def test_communities_are_those_of_every_vector(spark, sf_dir):
    rows = Tables(spark, sf_dir).embeddings.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    want = brute(ids, x, 5)
    pairs = {(min(i, j), max(i, j)) for i, js in want.items() for j in js}
    at = {int(i): n for n, i in enumerate(ids)}
    edges = spark.createDataFrame([(i, j, max(0.0, float(x[at[i]] @ x[at[j]]))) for i, j in sorted(pairs)], "src long, dst long, weight double")
    got = {r.node: r.label for r in QUERIES["knn_communities"](spark, sf_dir).collect()}
    assert set(got) == set(at)
    assert got == {r.node: r.label for r in K.label_propagation(edges).collect()}

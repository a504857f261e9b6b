"""Clustering, seeded samples and selections against NumPy and plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import batch as B
from tessella.operators import clustering as K
from tessella.operators import curriculum as C
from tessella.operators import groupmath as G
from tessella.operators import metrics as M
from tessella.operators import vectors as V


@pytest.fixture(scope="module")
def blobs(spark):
    """Three clouds of 60 points in five dimensions, far apart."""
    rng = np.random.default_rng(4)
    centre = np.array([[0, 0, 0, 0, 0], [9, 1, 0, 2, 0], [1, 9, 4, 0, 3]], dtype=float) + 1
    x = np.concatenate([c + rng.standard_normal((60, 5)) * [0.6, 0.4, 0.5, 0.3, 0.7] for c in centre])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3).cache()
    return x, df


def by_id(rows, *columns):
    return [np.array([r[c] for r in sorted(rows, key=lambda r: r["id"])]) for c in columns]


def same_partition(a, b):
    return len({*zip(a.tolist(), b.tolist())}) == len(set(a.tolist())) == len(set(b.tolist()))


TRUE = np.repeat([0, 1, 2], 60)


def test_pca_against_eigenvectors(blobs):
    x, df = blobs
    got = by_id(K.pca(df, "x", 3).collect(), "pca")[0]
    values, vectors = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(0)) @ vectors[:, np.argsort(-values)[:3]]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    unit = by_id(K.pca(df, "x", 9, renormalize=True).collect(), "pca")[0]
    assert unit.shape == (180, 5) and np.allclose(np.linalg.norm(unit, axis=1), 1)
    with pytest.raises(ValueError):
        K.pca(df.limit(2), "x", 2)


@pytest.mark.parametrize("method", ["kmeans", "bisecting_kmeans"])
def test_kmeans_puts_each_with_its_nearest_centre(blobs, method):
    x, df = blobs
    label, distance = by_id(K.cluster(df, "x", method, 3).collect(), "cluster_id", "distance_to_centroid")
    assert same_partition(label, TRUE)
    centres = np.array([x[label == c].mean(0) for c in range(3)])
    d = np.linalg.norm(x[:, None] - centres, axis=2)
    assert (d.argmin(1) == label).all() and np.allclose(d.min(1), distance, atol=1e-6)


def test_spherical_kmeans_ignores_lengths(blobs, spark):
    x, df = blobs
    longer = df.withColumn("x", F.transform("x", lambda v: v * (F.col("id") % 7 + 1)))
    a = by_id(K.cluster(df, "x", "spherical_kmeans", 3).collect(), "cluster_id")[0]
    b = by_id(K.cluster(longer, "x", "spherical_kmeans", 3).collect(), "cluster_id")[0]
    assert same_partition(a, b)


def test_diagonal_mixture_against_plain_em(blobs):
    x, df = blobs
    out, stats = K.diagonal_mixture(df, "x", 3)
    label, sure = by_id(out.collect(), "cluster_id", "cluster_confidence")
    assert same_partition(label, TRUE) and sure.min() > 0.9 and abs(stats["mean_confidence"] - sure.mean()) < 1e-9
    mean = np.array([x[TRUE == c].mean(0) for c in range(3)])
    var, w = np.array([x[TRUE == c].var(0) for c in range(3)]) + 1e-6, np.full(3, 1 / 3)
    for _ in range(50):
        logs = np.log(w) - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((x[:, None] - mean) ** 2 / var).sum(2))
        total = np.log(np.exp(logs).sum(1))
        p = np.exp(logs - total[:, None])
        w, mean = p.mean(0), p.T @ x / p.sum(0)[:, None]
        var = p.T @ (x * x) / p.sum(0)[:, None] - mean**2 + 1e-6
    free = 2 + 2 * 3 * 5
    assert abs(stats["aic"] - (2 * free - 2 * total.sum())) < 1 and abs(stats["bic"] - (free * np.log(180) - 2 * total.sum())) < 1


def test_label_propagation_finds_cliques(spark):
    edges = [(a + o, b + o, 1.0) for o in (0, 10, 20) for a in range(6) for b in range(a)] + [(0, 10, 0.1), (11, 20, 0.1)]
    got = {r.node: r.label for r in K.label_propagation(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    assert all(len({got[i + o] for i in range(6)}) == 1 for o in (0, 10, 20)) and len(set(got.values())) == 3


def test_random_k_and_fractions(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(1000)] + [(5000, 9)], "id long, c long")
    a = {(r.c, r.id) for r in C.random_k(df.repartition(5), "c", "id", 7, 1).collect()}
    assert a == {(r.c, r.id) for r in C.random_k(df, "c", "id", 7, 1).collect()} != {(r.c, r.id) for r in C.random_k(df, "c", "id", 7, 2).collect()}
    assert sorted(np.unique([c for c, _ in a], return_counts=True)[1].tolist()) == [1, 7, 7, 7, 7]
    for fraction, n in ((0.25, 250), (0.0005, 1), (0.0, 1), (1.0, 1001)):
        got = [r.id for r in C.fraction_subset(df, "id", fraction, 3).collect()]
        assert len(got) == len(set(got)) == n and sorted(got) == sorted(r.id for r in C.fraction_subset(df.repartition(7), "id", fraction, 3).collect())
    assert sorted(r.id for r in C.sample_rows(df, "id", 5).collect()) == [0, 1, 2, 3, 4]
    assert C.sample_rows(df, "id", 0).count() == 1001 and C.sample_rows(df, "id", 40, seed=1).distinct().count() == 40


def test_first_rows_totals_and_quantiles(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 50, 500) / 7
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double").repartition(6)
    assert sorted(r.id for r in B.first_rows(df, 37, "v", "id").collect()) == sorted(np.lexsort((np.arange(500), v))[:37].tolist())
    total = {r.id: r.total for r in B.running_total(df, F.col("v"), "id").collect()}
    assert np.allclose([total[i] for i in range(500)], np.cumsum(v))
    q = B.exact_quantiles(df, F.col("v"), {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).first()
    assert np.allclose([q.a, q.b, q.c, q.d], np.quantile(v, [0, 0.37, 0.5, 1]))
    one = spark.createDataFrame([(1.5,), (None,)], "v double")
    assert B.exact_quantiles(one, F.col("v"), {"p": 0.9}).first().p == 1.5


def test_resample_draws_by_weight(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, w double").repartition(4)
    draws = G.resample(df, F.col("w"), "id", 20_000, seed=1)
    n = {r.id: r["count"] for r in draws.groupBy("id").count().collect()}
    assert sum(n.values()) == 20_000 and 0 not in n and draws.select("draw").distinct().count() == 20_000
    assert all(abs(n[i] / 20_000 - i / 45) < 0.012 for i in range(1, 10))
    assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, G.resample(df.repartition(2), F.col("w"), "id", 20_000, seed=1).collect()))
    with pytest.raises(ValueError):
        G.resample(df, F.lit(0.0), "id", 3)


def test_clip_cov_takes_its_share_of_the_band(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(k), float(a), float(b), float(c)) for i in range(50) for k, (a, b, c) in enumerate(rng.standard_normal((8, 3)) * [0.1, 0.1, 2])]
    df = spark.createDataFrame(rows, "seq long, pos int, logp double, old double, adv double")
    out = G.clip_cov_loss(df, ["seq", "pos"], F.col("logp"), F.col("old"), F.col("adv"), F.lit(True), ratio=0.05, low=0.0).collect()
    lp, old, adv = (np.array([r[c] for r in rows]) for c in (2, 3, 4))
    ratio = np.exp(lp - old)
    l1, l2 = -adv * ratio, -adv * np.clip(ratio, 0.8, 1.2)
    cov = (adv - adv.mean()) * (lp - lp.mean())
    band = dict(zip([r[:2] for r in rows], (cov > 0) & (cov < 5) & (l2 <= l1)))
    loss = dict(zip([r[:2] for r in rows], np.maximum(l1, l2)))
    zero = [(r.seq, r.pos) for r in out if r.loss == 0]
    assert len(zero) == 20 and all(band[k] for k in zero)
    assert all(abs(r.loss - loss[r.seq, r.pos]) < 1e-12 for r in out if r.loss != 0)


def test_majority_of_k(spark):
    rows = [("s", u, f"{'ab'[i % 4 == 3]}", float(i % 4 != 3), i) for u in range(6) for i in range(8)]
    df = spark.createDataFrame(rows, "source string, uid long, pred string, value double, i long")
    got = {r.k: (r.maj_mean, r.maj_std) for r in M.majority_at_k(df, "source", "uid", "pred", "value", "i").collect()}
    assert set(got) == {2, 4, 8}
    assert abs(got[2][0] - 0.75) < 0.03  # of two that differ, the first counts
    assert 0.75 < got[4][0] < got[8][0] and 0 < got[8][1] < got[2][1]


def test_knn_edges_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    d = np.linalg.norm(x[:, None] - x, axis=2) + np.diag(np.full(90, np.inf))
    want = {(min(i, j), max(i, j)) for i in range(90) for j in np.argsort(d[i], kind="stable")[:3].tolist()}
    got = V.knn_edges(V.knn(df, df, "id", "x", 3, 4), df, "id", "x").collect()
    assert {(r.src, r.dst) for r in got} == want and all(abs(r.weight - max(0, x[r.src] @ x[r.dst])) < 1e-9 for r in got)


def test_spanning_tree_and_density_clusters(spark):
    """The tree against Prim's; clusters of planted clouds, with scattered noise left out."""
    from tessella.operators import density as D

    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, s, (60, 2)) for c, s in (((0, 0), 0.3), ((6, 0), 0.3), ((0, 8), 0.8))] + [rng.uniform(-6, 14, (20, 2))])
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    d = np.linalg.norm(x[:, None] - x, axis=2)
    core = np.sort(d, axis=1)[:, 9]
    got = {r.id: r.core for r in D.core_distances(df, "id", "x", 10, 2).collect()}
    assert np.allclose([got[i * 3] for i in range(200)], core)
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    joined, near, come, edges = {0}, m[0].copy(), np.zeros(200, int), []
    while len(joined) < 200:
        j = min((j for j in range(200) if j not in joined), key=lambda j: near[j])
        edges.append((int(come[j]), j, float(near[j])))
        joined.add(j)
        come = np.where(m[j] < near, j, come)
        near = np.minimum(near, m[j])
    rows = df.select(F.col("id").alias("k"), F.col("x").alias("v")).join(D.core_distances(df, "id", "x", 10, 2).withColumnRenamed("id", "k"), "k")
    tree = D.spanning_tree(rows, 2).collect()
    assert len(tree) == 199 and abs(sum(r.w for r in tree) - sum(e[2] for e in edges)) < 1e-5
    out = {r.id: (r.cluster_id, r.cluster_confidence) for r in D.hdbscan(df, "id", "x", 2, 15, 10).collect()}
    label = np.array([out[i * 3][0] for i in range(200)])
    assert len(out) == 200 and set(label) == {-1, 0, 1, 2}
    for c in range(3):
        own = label[c * 60 : c * 60 + 60]
        assert (own == np.bincount(own[own >= 0]).argmax()).mean() > 0.9
    assert (label == D.condense(edges, 200, 15)[0]).mean() > 0.97 and (label[180:] == -1).any()  # the tree is one only up to ties
    assert all(0 <= s <= 1 and (s > 0 or c == -1) for c, s in out.values())
    assert {r.cluster_id for r in D.hdbscan(df.limit(5), "id", "x", 2, 15).collect()} == {-1}

"""Estimators on hand-made groups, and against plain restatements of the formulas."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.operators import groupmath as G
from tessella.operators import metrics as M
from tessella.operators import rejection as R

GROUPS = [("a", 0, 1.0, 3), ("a", 1, 0.0, 1), ("a", 2, 1.0, 2), ("b", 3, 5.0, 4), ("c", 4, 2.0, 1), ("c", 5, 2.0, 2), *[("d", i, 0.0, 1) for i in range(6, 10)]]


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame(GROUPS, "uid string, seq long, score double, length long")


def adv(df):
    return {r.seq: r.advantage for r in df.collect()}


def test_singletons_and_zero_variance(groups):
    grpo, rloo, vec, opo = (adv(G.advantage(n)(groups)) for n in ("grpo", "rloo", "rloo_vectorized", "opo"))
    sd = np.std([1, 0, 1], ddof=1)
    assert math.isclose(grpo[0], (1 - 2 / 3) / (sd + 1e-6)) and math.isclose(grpo[3], 5 / (1 + 1e-6)) and grpo[4] == 0
    assert rloo[3] == 5 and vec[3] == 0 and math.isclose(rloo[0], 0.5) and math.isclose(vec[0], 0.5)
    assert opo[3] == 5 and math.isclose(opo[0], 1 - 5 / 6)
    with pytest.raises(ValueError):
        G.advantage("nope")


def test_passk_takes_the_first_of_ties_and_rejects_singletons(groups):
    got = adv(G.advantage("grpo_passk")(groups.where("uid <> 'b'")))
    assert got[0] == 0 and got[2] == 0 and got[1] == 0  # the two best are equal
    with pytest.raises(PySparkException):
        G.advantage("grpo_passk")(groups).collect()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-2, 2), st.floats(-2, 2), st.integers(0, 1)), min_size=1, max_size=9), st.floats(0.5, 1), st.floats(0.5, 1))
def test_folds_equal_plain_loops(spark, steps, gamma, lam):
    r, v, m = (list(x) for x in zip(*steps))
    df = spark.createDataFrame([(r, v, m)], "r array<double>, v array<double>, m array<int>")
    got = df.select(G.gae(F.col("r"), F.col("v"), F.col("m"), gamma, lam), G.discounted_return(F.col("r"), F.col("m"), gamma)).first()
    nv = last = run = 0.0
    want, ret = [], []
    for t in reversed(range(len(r))):
        l = r[t] + gamma * nv - v[t] + gamma * lam * last
        nv, last = (v[t], l) if m[t] else (nv, last)
        want.append(last)
        run = r[t] + gamma * run
        ret.append(run)
        run *= m[t]
    assert np.allclose(got[0], want[::-1], atol=1e-12) and np.allclose(got[1], ret[::-1], atol=1e-12)


def test_eos_mask_of_the_docstring(spark):
    rows = [[20, 10, 34, 1, 0, 0, 0], [78, 0, 76, 2, 1, 0, 0], [23, 98, 1, 0, 0, 0, 0], [33, 3, 98, 45, 1, 0, 0]]
    df = spark.createDataFrame([(i, p, x) for i, r in enumerate(rows) for p, x in enumerate(r)], "seq int, pos int, tok int")

    def mask(eos):
        m = G.eos_mask(df, ["seq"], "pos", F.col("tok").isin(*eos)).orderBy("seq", "pos").collect()
        return [[r.response_mask for r in m if r.seq == i] for i in range(4)]

    # the documented example (fixed values)
    assert mask([1]) == [[1, 1, 1, 1, 0, 0, 0], [1, 1, 1, 1, 1, 0, 0], [1, 1, 1, 0, 0, 0, 0], [1, 1, 1, 1, 1, 0, 0]]
    assert mask([1, 2])[1] == [1, 1, 1, 1, 0, 0, 0]


def test_longest_response_alone_has_no_baseline(spark):
    rows = [(0, 0, p, 1.0) for p in range(4)] + [(0, 1, p, 1.0) for p in range(2)] + [(1, 2, p, 1.0) for p in range(3)]
    df = spark.createDataFrame(rows, "uid int, seq int, pos int, r double").withColumn("m", F.lit(True))
    a = G.optimal_token_baseline(df, "uid", "seq", "pos", F.col("r"), F.lit(1.0), F.col("m"))
    got = {(x.seq, x.pos): x.advantage for x in a.collect()}
    assert (got[0, 2], got[0, 3]) == (2, 1) and got[2, 0] == 3 and math.isclose(got[0, 0], 1, abs_tol=1e-6) and math.isclose(got[1, 0], -1, abs_tol=1e-6)


def test_clip_cov_takes_its_share(spark):
    df = spark.range(400).select(F.col("id"), (-F.col("id") / 100).alias("lp"), (F.col("id") / 100 - 2).alias("a"))
    got = G.clip_cov_loss(df, ["id"], F.col("lp"), F.col("lp"), F.col("a"), F.lit(True), ratio=0.05, low=-9.0, high=9.0).collect()
    assert len(got) == 400 and sum(r.loss == 0 and abs(r.a) > 1e-9 for r in got) in (19, 20)


def test_agg_loss_leaves_fully_masked_sequences_out(spark):
    rows = [(0, 1.0, True), (0, 2.0, True), (1, 4.0, True), (1, 9.0, False), (2, 7.0, False)]
    got = G.aggregate_loss(spark.createDataFrame(rows, "seq int, x double, m boolean"), ["seq"], F.col("x"), F.col("m")).first()
    assert got.token_mean == 7 / 3 and got.seq_mean_token_sum == 3.5 and math.isclose(got.seq_mean_token_mean, 2.75, rel_tol=1e-6)


def test_thresholds_and_rejection_edges(spark):
    assert R.parse_threshold("0.1_1.2") == (0.1, 1.2) and R.parse_threshold(2, k1=True) == (0.5, 2.0) and R.parse_threshold("2") == (None, 2.0)
    for bad in ("0", "2_1", "1_2_3"):
        with pytest.raises(ValueError):
            R.parse_threshold(bad)
    df = spark.createDataFrame([(0, 0, 0.0, True), (0, 1, 25.0, True), (1, 0, -0.1, True), (1, 1, float("nan"), False)], "seq int, pos int, lr double, m boolean")
    kept = {(r.seq, r.pos): r.kept for r in R.rejection_mask(df, ["seq"], F.col("lr"), F.col("m"), {"seq_sum_k1": "0.5_2"}).collect()}
    assert kept == {(0, 0): False, (0, 1): False, (1, 0): True, (1, 1): False}
    w = {(r.seq, r.pos): r.is_weight for r in R.is_weights(df, ["seq"], F.col("lr"), F.col("m"), "token", 2.0).collect()}
    assert w[0, 1] == 2.0 and w[1, 1] == 0.0 and w[0, 0] == 1.0


def test_metrics_of_the_docstrings(spark):
    df = spark.createDataFrame([("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("accuracy", 0.8), ("accuracy", 0.9), ("accuracy", 0.7), ("max_reward", 5.0), ("max_reward", 8.0), ("max_reward", 6.0), ("min_error", 0.1), ("min_error", 0.05), ("min_error", 0.2)], "name string, v double")
    got = {r.name: r.reduced for r in M.reduce_by_name(df, "name", "v").collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {"loss": 2.0, "accuracy": 0.8, "max_reward": 8.0, "min_error": 0.05}
    vote = spark.createDataFrame([(0, 0, "A", 0.9), (0, 1, "B", 0.8), (0, 2, "A", 0.7), (1, 3, "x", 1.0), (1, 4, "y", 2.0)], "g int, o int, p string, v double")
    assert {r.g: (r.majority_pred, r.majority_value) for r in M.majority_vote(vote, ["g"], "p", "v", "o").collect()} == {0: ("A", 0.9), 1: ("x", 1.0)}


def test_bootstrap_approaches_the_exact_value(spark):
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([1, 3, 3, 7, 9, 2])], "g int, i int, v double")
    exact = {r.k: r.best_mean for r in M.best_of_k(df, ["g"], "v", "i").collect()}
    assert sorted(exact) == [2, 4, 6]
    boot = M.bootstrap(df, ["g"], "v", 4, {"best": np.max}, rounds=4000).first()
    assert abs(boot.best_mean - exact[4]) < 0.1


def test_bootstrap_query_has_every_prompt(spark, sf_dir):
    from tessella.plans import metric_queries  # noqa: F401
    from tessella.plans.registry import QUERIES, Tables

    t = Tables(spark, sf_dir)
    got = {r.uid: r for r in QUERIES["bootstrap_best_n"](spark, sf_dir).collect()}
    scores = {}
    for r in t.responses.orderBy("seq").collect():
        scores.setdefault(r.uid, []).append(r.score)
    assert set(got) == set(scores) and max(got) >= 50
    for uid, v in scores.items():  # the mean of the best of four draws, to the noise of 1000 rounds
        v, n = sorted(v), len(v)
        exact = sum(x * (((i + 1) / n) ** 4 - (i / n) ** 4) for i, x in enumerate(v))
        assert abs(got[uid].best_mean - exact) <= 6 * got[uid].best_std / 1000**0.5 + 1e-9
    rng = np.random.RandomState(42)
    assert (np.array([rng.choice(7, size=4) for _ in range(1000)]) == np.random.RandomState(42).choice(7, size=(1000, 4))).all()

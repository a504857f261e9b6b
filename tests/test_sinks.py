"""Errors of writers, unions, dispatchers and reward managers."""

import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.functions import registry as R
from tessella.functions import scoring as S
from tessella.functions import text as T
from tessella.operators import batch as B
from tessella.operators import groupmath as G
from tessella.operators.scheduler import Scheduler, move
from tessella.sources import sinks as W


def test_unions_of_unequal_batches_are_errors(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, float("nan"))], "i long, x double")
    b = spark.createDataFrame([(0, 1.0, "a"), (1, 2.0, "b"), (2, float("nan"), "c")], "i long, x double, y string")
    assert sorted((r.i, r.y) for r in B.union_batches(a, b, ["i"]).collect()) == [(0, "a"), (1, "b"), (2, "c")]
    for left, right in ((a.limit(2), b), (a, b.where("i < 2")), (a, b.withColumn("x", F.col("x") + 1))):
        with pytest.raises(PySparkException):
            B.union_batches(left, right, ["i"]).collect()


def test_meta_information(spark):
    nan = float("nan")
    assert B.union_meta({"a": 1, "n": nan}, {"a": 1, "b": 2, "n": nan}).keys() == {"a", "b", "n"}
    with pytest.raises(ValueError):
        B.union_meta({"a": 1}, {"a": 2})
    a, b = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2)], "k string, v int")
    with pytest.raises(PySparkException):
        B.union_meta_tables(a, b, "k", "v").collect()


def test_get_item(spark):
    df = spark.range(6).withColumnRenamed("id", "row_idx")
    ids = lambda x: [r.row_idx for r in x.orderBy("out_pos" if "out_pos" in x.columns else "row_idx").collect()]
    assert ids(B.get_item(df, slice(1, -1, 2))) == [1, 3] and ids(B.get_item(df, -2)) == [4] and ids(B.get_item(df, [5, 0, 5])) == [5, 0, 5]
    assert ids(B.get_item(df, [True, False, False, True, False, False])) == [0, 3] and ids(B.get_item(df, [])) == []
    for bad, error in (("x", TypeError), (1.5, TypeError), ([True], ValueError)):
        with pytest.raises(error):
            B.get_item(df, bad)


def test_generations_and_preferences_of_wrong_shape(spark):
    p = spark.createDataFrame([(1,), (2,)], "id long")
    g = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "id long, sample int, response string")
    assert W.generation_table(p.where("id = 1"), g, "id", 2).first().responses == ["a", "b"]
    for prompts in (p, spark.createDataFrame([(3,)], "id long")):
        with pytest.raises(PySparkException):
            W.generation_table(prompts, g, "id", 2).collect()
    with pytest.raises(PySparkException):
        W.preference_pairs(spark.createDataFrame([(1, "p", "a", None)], "id long, p string, c string, r string"), "id", "p", "c", "r").collect()


def test_local_copy_is_made_once_and_checked(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a.parquet"))
    path = W.local_copy(spark, str(tmp_path / "a.parquet"), str(tmp_path / "cache"))
    again = W.local_copy(spark, str(tmp_path / "a.parquet"), str(tmp_path / "cache"))
    assert path == again and spark.read.parquet(path).count() == 5
    spark.range(50).write.mode("overwrite").parquet(str(tmp_path / "a.parquet"))
    assert spark.read.parquet(W.local_copy(spark, str(tmp_path / "a.parquet"), str(tmp_path / "cache"))).count() == 50
    with pytest.raises(FileNotFoundError):
        W.local_copy(spark, str(tmp_path / "none"), str(tmp_path / "cache"))


def test_terms_come_back_as_written(spark, tmp_path):
    w = spark.createDataFrame([("a", "x, y", 1, 0.5), ("a", "z", 2, 0.25), ("b", 'q"', 1, 1.0)], "lang string, term string, rank int, weight double")
    W.write_terms(w, w.groupBy("lang").agg(F.avg("weight").alias("distinctiveness")), str(tmp_path), "lang")
    got = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "top_terms"))
    assert {(r.lang, r.rank) for r in got.collect()} == {("a", "1"), ("a", "2"), ("b", "1")} and spark.read.json(str(tmp_path / "distinctiveness")).count() == 2


@pytest.mark.parametrize("source", ["taco", "codecontests", "mathematics", "searchR1_x", "gsm8k", None])
def test_sources_without_a_scorer_are_errors(spark, source):
    df = spark.createDataFrame([(source, "a", "b")], "s string, t string, y string")
    with pytest.raises(PySparkException):
        df.select(S.score_by_source(F.col("s"), F.col("t"), F.col("y"))).collect()


@pytest.mark.parametrize("source", [x for v in S.SOURCES.values() for x in v] + ["aime24", "aime_2025"])
def test_every_source_has_its_scorer(source):
    assert source.startswith("aime") or sum(source in v for v in S.SOURCES.values()) == 1


def test_all_sources_score(spark):
    names = [x for v in S.SOURCES.values() for x in v] + ["aime24", "aime_2025"]
    text = "<think>x</think> #### 7 <answer>7</answer> \\boxed{7}\nAnswer: 7"
    df = spark.createDataFrame([(n, text, "7") for n in names], "s string, t string, y string")
    assert {r[0] for r in df.select(S.score_by_source(F.col("s"), F.col("t"), F.col("y"))).collect()} == {1.0}


def test_managers(spark):
    df = spark.createDataFrame([("openai/gsm8k", "#### 7", "7", 90), ("math_dapo", "Answer: 8", "7", 10)], "source string, text string, truth string, length int")
    score = lambda *a, **k: [r.score for r in R.reward(df, *a, **k).collect()]
    assert score() == [1.0, -1.0] and score("dapo", limit=100, buffer=20) == [0.5, -1.0]
    assert score("batch", scorer=lambda a, b: a.str.len()) == [6.0, 9.0]
    assert score("prime", scorer=lambda a, b: float(a[-1] == b)) == [1.0, 0.0]
    with pytest.raises(ValueError):
        R.reward(df, "none")


def test_a_scorer_that_never_returns_scores_as_failed(spark):
    def slow(text, truth):
        while text == "loop":
            pass
        if text == "die":
            import os

            os._exit(1)
        return len(text) / 0 if text == "bad" else len(text)

    df = spark.createDataFrame([(t,) for t in ("ab", "loop", "abc", "bad", "die", "abcd")], "t string").coalesce(1)
    began = time.time()
    got = [r.score for r in R.score_rows(df, slow, F.col("t"), F.col("t"), seconds=1.0).collect()]
    assert got == [2.0, 0.0, 3.0, 0.0, 0.0, 4.0] and time.time() - began < 30


def test_bypass_is_the_clipped_loss_or_the_weighted_one(spark):
    df = spark.createDataFrame([(0, -0.5, -0.7, 1.0), (0, -0.2, -0.1, -1.0)], "seq long, lp double, old double, adv double")
    args = (df, ["seq"], F.col("lp"), F.col("old"), F.col("adv"), F.lit(True))
    import math

    got = G.bypass_loss(*args, "reinforce").first()
    want = (-1.0 * min(math.exp(0.2), 2) * -0.5 + 1.0 * math.exp(-0.1) * -0.2) / 2
    assert abs(got.token_mean - want) < 1e-9
    assert G.bypass_loss(*args).first().token_mean == G.aggregate_loss(df, ["seq"], G.POLICY_LOSSES["vanilla"](F.col("lp"), F.col("old"), F.col("adv")), F.lit(True), 1.0).first().token_mean
    with pytest.raises(ValueError):
        G.bypass_loss(*args, "none")


def test_messages_of_missing_content_and_lengths(spark):
    df = spark.createDataFrame([(None,), ("",), ("[1",), ('{"a": [1, {"b": null}]}',)], "t string")
    got = [r[0] for r in df.select(F.to_json(T.message_list(T.variant(F.col("t"))))).collect()]
    assert got == ["[]", '[{"role":"user","content":""}]', '[{"role":"user","content":"[1"}]', '[{"role":"user","content":"{\\"a\\":[1,{\\"b\\":null}]}"}]']
    with pytest.raises(PySparkException):
        df.select(T.required(F.col("t"), "text")).collect()
    ids = spark.createDataFrame([([1, 2, 3],)], "x array<int>")
    assert ids.select(T.pad_or_cut(F.col("x"), 3, F.lit(0), cut="error")).first()[0] == [1, 2, 3]
    with pytest.raises(PySparkException):
        ids.select(T.pad_or_cut(F.col("x"), 2, F.lit(0), cut="error")).collect()


def test_schedule_with_names_and_moves_to_free_places():
    s = Scheduler({"a": 30, "b": 50}, batch=4, active=1, seed=3)
    s.emit()
    s.update({"a": {0: 1.0, 1: 1.0, 2: 0.0, 3: 0.5}})
    again = Scheduler.restore(s.save())
    assert again.positions == s.positions and again.emit() == s.emit() and set(again.sizes) == {"a", "b"}
    band = lambda r: "easier" if r < 0.33 else "harder" if r > 0.67 else "keep"
    assert move([0, 1, 2, 3], {0: 1.0, 1: 1.0, 2: 0.5, 3: 0.5}, 10, band) == [0, 1, 2, 3]
    assert move([4, 5, 6], {4: 0.5, 5: 0.0, 6: 0.0}, 10, band) == [3, 4, 5]


def test_classes_of_the_users_own(spark, tmp_path):
    (tmp_path / "own.py").write_text("""
class Sampler:
    def __init__(self, n): self.sizes, self.n, self.seen = {"a": n}, n, []
    def emit(self): return [("a", 0)]
    def update(self, rho): self.seen.append(rho)
class Broken:
    pass
class Data:
    def __init__(self, n): self.n = n
    def frame(self, spark): return spark.range(self.n).selectExpr("id", "repeat('x', int(id)) as t")
class Wrong:
    def frame(self, spark): return 3
class Generator:
    def generate(self, df): return df.selectExpr("id + 100 as id", "t")
""")
    path = str(tmp_path / "own.py")
    from tessella.operators import scheduler as Q

    s = R.load_sampler(path, "Sampler", n=3)
    rollouts = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 0.0), ("zz", 0, 1.0)], "c string, p int, ok double")
    Q.run_step(s, rollouts, "c", "p", F.col("ok"))
    assert s.seen == [{"a": {0: 0.5}}] and s.emit() == [("a", 0)]
    df = R.load_dataset(spark, path, "Data", n=5)
    assert sorted(r.id for r in R.generate_rows(df, path, "Generator", F.length("t"), 2).collect()) == [0, 1, 2, 3, 4, 100, 101, 102]
    for call in (lambda: R.load_sampler(path, "Broken"), lambda: R.load_dataset(spark, path, "Wrong")):
        with pytest.raises(TypeError):
            call()
    with pytest.raises(AttributeError):
        R.load_object(path, "None_")


def test_micro_batches_and_groups_of_every_batch(spark):
    from tessella.operators import balance as L

    rows = [(i // 40, i, i // 4, 1 + (i * 37) % 97) for i in range(120)]
    df = spark.createDataFrame(rows, "batch long, seq long, uid long, length long").repartition(3)
    micro = L.micro_batch_rows(df, "batch", "seq", "length", 500).collect()
    assert sorted(r.seq for r in micro) == list(range(120))
    for b in range(3):
        own = [r for r in rows if r[0] == b]
        parts = {}
        for r in micro:
            if r.batch == b:
                parts.setdefault(r.part, []).append(rows[r.seq][3])
        count = min(40, -(-sum(r[3] for r in own) // 500))
        cost = [sum(map(L.cost, parts[p])) for p in range(count)]
        assert len(parts) == count and max(cost) - min(cost) <= L.cost(97)
        top = cost.index(max(cost))
        assert cost[: top + 1] == sorted(cost[: top + 1]) and cost[top:] == sorted(cost[top:], reverse=True)
    grouped = L.grouped_rows(df, "batch", "seq", "uid", "length", 4).collect()
    assert sorted(r.seq for r in grouped) == list(range(120)) and len({(r.batch, r.part) for r in grouped}) == 12
    assert len({(rows[r.seq][2], r.part) for r in grouped}) == 30  # no prompt is split


def test_sample_of_a_replay_ring(spark):
    from tessella.streaming import rollouts as S

    ring = S.replay_ring(spark.range(1000).selectExpr("id as event_id", "id * 1.0 as value"), "event_id", 128)
    got = [(r.slot, r.event_id) for r in S.replay_sample(ring, 50, 1).collect()]
    assert len(set(got)) == 50 and all(e >= 872 and e % 128 == s for s, e in got) and S.replay_sample(ring, 500, 1).count() == 128

"""Sources, sinks and text functions."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import curriculum as C
from tessella.sources import io


def test_sources_and_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert io.write_verified(df, str(tmp_path / "a.parquet")) == 10
    df.write.json(str(tmp_path / "b.jsonl"))
    assert io.load_many(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.jsonl")]).count() == 20
    assert io.load_source(spark, str(tmp_path / "a.parquet")).first().source_split == "local"
    with pytest.raises(ValueError):
        io.load_raw(spark, "x", "csv")
    assert io.write_once(df, str(tmp_path / "c.parquet")) and not io.write_once(df, str(tmp_path / "c.parquet"))
    for r in (0, 1):
        df.where(F.col("id") % 2 == r).write.parquet(io.shard_path(str(tmp_path), "emb", r))
    assert [r.id for r in io.merge_shards(spark, str(tmp_path), "emb", 2, "id").collect()] == list(range(10))
    with pytest.raises(FileNotFoundError):
        io.merge_shards(spark, str(tmp_path), "emb", 3, "id")
    path = str(tmp_path / "summary")
    io.upsert_table(spark, path, df, ["id"])
    got = io.upsert_table(spark, path, spark.createDataFrame([(3, 99), (50, 1)], "id long, x long"), ["id"])
    assert {r.id: r.x for r in got.collect()} == {i: 2 * i for i in range(10)} | {3: 99, 50: 1}


def test_rollout_log(spark, tmp_path):
    (tmp_path / "12.jsonl").write_text('{"input": "a secret", "score": 1.5, "extra": {"k": 1}}\n')
    got = io.rollout_log(spark, str(tmp_path), mask="secret").first()
    assert got.step == 12 and got.input == "a *" and got.score == "1.5" and got.extra == '{"k":1}'


def test_strict_join_and_infinite_scores(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(KeyError):
        C.strict_join(a, spark.createDataFrame([(1, 2)], "k int, v int"), "k")
    with pytest.raises(ValueError):
        C.strict_join(a, spark.createDataFrame([(1, 2), (1, 3), (2, 1)], "k int, v int"), "k")
    d = spark.createDataFrame([(0, 0.5), (1, 0.5), (2, float("inf")), (3, 1.2)], "id int, d double").withColumn("c", F.lit(0))
    ranked = C.rank_in_cluster(C.replace_infinite(d, "d"), "c", "d", "id").orderBy("rank_in_cluster").collect()
    assert [r.id for r in ranked] == [0, 1, 3, 2] and ranked[-1].d == 2.2


def test_ids_and_messages(spark):
    rows = [("3", None, 10), ("7", None, 11), (" 8 ", None, 12), ("9.0", None, 13), (None, None, 14), ("", 4, 15), ("abc", -1, 16)]
    df = spark.createDataFrame(rows, "d string, i int, r int")
    assert [x[0] for x in df.select(T.ensure_sample_id(F.col("d"), F.col("i"), F.col("r"))).collect()] == [3, 7, 8, 9, 14, 4, 16]
    m = spark.createDataFrame([([("System", " s "), ("user", "q"), ("assistant", "a"), ("user", "  ")],), ([],)], "m array<struct<role:string,content:string>>")
    got = m.select(T.question_text(F.col("m")).alias("q"), T.join_contents(F.col("m")).alias("all"), F.size(T.normalize_messages(F.col("m"))).alias("n")).collect()
    assert (got[0].q, got[0].all, got[0].n) == ("q", "s\n\nq\n\na", 3) and (got[1].q, got[1].n) == ("", 0)

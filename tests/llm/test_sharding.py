"""op1: the permutation is one, shards and slots follow from it, edges."""

import zlib

import pytest
from pyspark.sql import functions as F

from tessella.llm import queries, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 64, 97, 1000, 1025])
def test_permutation(spark, n):
    df = spark.range(n).select(*[sharding.permute(F.col("id"), F.lit(n).cast("long"), F.lit(k).cast("long")).alias(f"p{k}") for k in (1, 2)])
    rows = df.collect()
    assert sorted(r.p1 for r in rows) == sorted(r.p2 for r in rows) == list(range(n))
    if n > 20:
        assert [r.p1 for r in rows] != [r.p2 for r in rows] and [r.p1 for r in rows] != list(range(n))


def test_permutation_spreads(spark):
    n = 20_000
    r = spark.range(n).select("id", sharding.permute(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).agg(F.corr("id", "p"), F.avg(F.abs(F.col("id") - F.col("p")))).first()
    assert abs(r[0]) < 0.03 and abs(r[1] / n - 1 / 3) < 0.02


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    run = lambda: queries.queries()["op1_sharding"](spark, sf_dir)
    got = run().collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(counts) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    # the place is computable: number the rows as documented, permute, divide
    numbered = sharding.number_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id", [])
    place = {r.doc_id: r.p for r in numbered.select("doc_id", sharding.permute(F.col("row_no"), F.col("n_rows"), F.lit(0).cast("long")).alias("p")).collect()}
    assert all(place[r.doc_id] == r.slot * 16 + r.shard for r in got)


def test_same_result_in_any_partitioning_and_edges(spark):
    df = spark.createDataFrame([(i, f"t{i}" * (i % 5)) for i in range(50)] + [(None, "x"), (None, None), (7, None), (7, "é")], "doc_id long, text string").selectExpr("*", "1 as size", "2 as row_no", "3 as shard")
    a, b = (sorted(sharding.shard_rows(df.repartition(p), 4).collect(), key=lambda r: (r.shard, r.slot)) for p in (1, 7))
    assert a == b and len(a) == 54
    assert {(r["size"], r.text_crc32) for r in a if r.doc_id is None} == {(2, zlib.crc32(b"x")), (1, 0)}
    assert {r["size"] for r in a if r.doc_id == 7} == {1, 3, 5}
    assert sharding.shard_rows(df.limit(0)).count() == 0
    assert [(r.shard, r.slot) for r in sharding.shard_rows(df.limit(1)).collect()] == [(0, 0)]

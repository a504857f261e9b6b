"""Row addressing on hand-made batches."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.operators import batch as B


@pytest.fixture(scope="module")
def ten(spark):
    return B.with_row_index(spark.range(10).withColumn("x", F.col("id") * 10).repartition(3), "id")


def ids(df, order="row_idx"):
    return [r.id for r in df.orderBy(order).collect()]


def test_row_index_is_gapless_in_any_partitioning(spark):
    for parts in (1, 4, 16):
        df = B.with_row_index(spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(parts), "k")
        got = {r.k: r.row_idx for r in df.collect()}
        assert got == {k: k for k in range(1000)}
    assert B.with_row_index(spark.range(0), "id").count() == 0


@pytest.mark.parametrize("cut", [(2, 7, 1), (None, None, 3), (-4, None, 1), (1, -1, 2), (0, 0, 1), (8, 100, 1)])
def test_slices_follow_python(ten, cut):
    a, b, c = cut
    assert ids(B.slice_rows(ten, a, b, c)) == list(range(10))[slice(a, b, c)]


def test_gather_keeps_order_and_duplicates(spark, ten):
    p = spark.createDataFrame(list(enumerate([3, 3, 9, 0])), "out_pos int, row_idx long")
    assert ids(B.take_rows(ten, p), "out_pos") == [3, 3, 9, 0]


def test_union_rejects_conflicts(spark):
    a = spark.createDataFrame([(1, 1.0), (2, float("nan"))], "k int, x double")
    assert B.union_batches(a, a.withColumn("y", F.lit(1)), ["k"]).count() == 2
    with pytest.raises(PySparkException):
        B.union_batches(a, a.withColumn("x", F.lit(5.0)), ["k"]).collect()


def test_pad_to_divisor_of_the_docstring(spark, ten):
    padded = B.pad_to_divisor(ten, 4, 10).orderBy("row_idx").collect()
    assert [r.id for r in padded] == [*range(10), 0, 1] and [r.padded for r in padded] == [False] * 10 + [True] * 2
    few = B.with_row_index(spark.range(3), "id")
    assert ids(B.pad_to_divisor(few, 8, 3)) == [0, 1, 2, 0, 1, 2, 0, 1]
    assert B.pad_to_divisor(few, 3, 3).count() == 3


def test_chunks_shards_and_orders(spark, ten):
    with pytest.raises(ValueError):
        B.chunk_rows(ten, 3, 10)
    assert [r.shard for r in B.contiguous_shards(ten, 3, 10).orderBy("row_idx").collect()] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    z = {r.p: r.id for r in ten.select("id", B.zigzag_order(F.lit(10), F.col("row_idx")).alias("p")).collect()}
    x = list(range(10))
    assert [z[i] for i in range(10)] == x[::2] + x[1::2][::-1]
    r = B.repeat_rows(ten, 2, interleave=False).orderBy("out_idx")
    assert [q.id for q in r.collect()] == x + x
    with pytest.raises(KeyError):
        B.select_columns(ten, ["nope"])


def test_mini_batches_are_permutations(spark):
    m = B.shuffled_mini_batches(spark.range(100), "id", 10, 3, epochs=2).collect()
    for e in (0, 1):
        own = [r for r in m if r.epoch == e]
        assert sorted(r.id for r in own) == list(range(100)) and {sum(r.mini_batch == k for r in own) for k in range(10)} == {10}
    assert [r.id for r in sorted(m, key=lambda r: r.place) if r.epoch == 0] != [r.id for r in sorted(m, key=lambda r: r.place) if r.epoch == 1]

"""Partitions, the schedule's transitions, and restart from a saved state."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import balance as L
from tessella.operators.scheduler import Scheduler, move
from tessella.streaming import rollouts as R


def spread(work, parts):
    sums = [sum(work[i] for i in p) for p in parts]
    return max(sums) - min(sums)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=4, max_size=40), st.integers(2, 4))
def test_partitions_use_each_row_once(work, k):
    for parts in (L.differencing(work, k), L.greedy(work, k)):
        assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(len(work)))
    n = len(work) // k * k
    assert {len(p) for p in L.differencing(work[:n], k, equal_size=True)} == {n // k}


def test_differencing_is_not_worse_than_greedy_on_average():
    rng = random.Random(0)
    a = b = 0
    for _ in range(50):
        work = [rng.randrange(1, 1000) for _ in range(24)]
        a, b = a + spread(work, L.differencing(work, 4)), b + spread(work, L.greedy(work, 4))
    assert a <= b


def test_micro_batches_and_groups():
    lengths = [100, 200, 300, 400, 50, 60]
    parts = L.micro_batches(lengths, 400)
    assert sorted(i for p in parts for i in p) == list(range(6)) and len(parts) == 3
    uids = ["a", "a", "b", "b", "c", "c"]
    for p in L.grouped_partition(lengths, uids, 2):
        assert all(i ^ 1 in p for i in p)


def test_balance_batches(spark):
    df = spark.range(64).select((F.col("id") % 2).alias("b"), F.col("id").alias("k"), (F.col("id") * 37 % 101 + 1).alias("n"))
    rows = L.balance_batches(df, "b", "k", "n", 4).collect()
    assert len(rows) == 64 and {(r.b, r.part): 0 for r in rows}.keys() == {(b, p) for b in (0, 1) for p in range(4)}
    for b in (0, 1):
        sums = [sum(L.cost(r.n) for r in rows if r.b == b and r.part == p) for p in range(4)]
        assert max(sums) / min(sums) < 1.2


def test_moves():
    band = Scheduler({0: 10}).band
    assert [band(x) for x in (0.2, 0.33, 0.5, 0.67, 0.9)] == ["easier", "keep", "keep", "keep", "harder"]
    assert move([0, 1, 3], {0: 0.9, 1: 0.5, 3: 0.5}, 10, band) == [1, 2, 3]  # 1 is taken, the search goes on upwards
    assert move([0, 1, 2], {0: 0.9, 1: 0.5, 2: 0.5}, 10, band) == [0, 1, 2]  # at each distance upwards first, then downwards
    assert move([4, 5], {4: 0.1, 5: 0.9}, 10, band) == [3, 6]
    assert move([0, 9], {0: 0.0, 9: 1.0}, 10, band) == [0, 9]
    assert move([0, 1], {0: 1.0, 1: 1.0}, 2, band) == [0, 1]  # small clusters don't move


def test_restart_equals_an_uninterrupted_run():
    def rates(step, batch):
        return {c: {p: ((c * 31 + p * 17 + step * 7) % 10) / 9 for cc, p in batch if cc == c} for c, _ in batch}

    one = Scheduler({0: 10, 1: 5, 2: 2}, batch=3, active=2)
    two = Scheduler({0: 10, 1: 5, 2: 2}, batch=3, active=2)
    for step in range(12):
        a, b = one.emit(), two.emit()
        assert a == b and len({c for c, _ in a}) == 2
        one.update(rates(step, a)), two.update(rates(step, b))
        assert abs(sum(one.prob.values()) - 1) < 1e-12
        two = Scheduler.restore(two.save())
    assert one.save() == two.save()
    assert one.epoch_steps == 2 and one.steps_in_epoch < 2


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    schema = "event_id long, user_id long, value double, ts timestamp"
    rows = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.col("id").cast("double").alias("value"), (F.lit(1_700_000_000) + F.col("id") * 600).cast("timestamp").alias("ts"))
    for i in range(2):
        rows.where(f"event_id div 20 = {i}").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = R.bounded_buffer(stream, "user_id", "event_id", "event_id", 4).writeStream.format("memory").queryName("buffer").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.user_id: r for r in spark.table("buffer").orderBy("produced").collect()}
    assert {u: (r.produced, r.dropped, len(r.held)) for u, r in last.items()} == {0: (14, 10, 4), 1: (13, 9, 4), 2: (13, 9, 4)}
    q = R.windowed_counts(stream, "ts", "user_id", "value").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("windows").collect()) > 0


def test_schedule_as_a_stream_equals_the_batch_fold(spark, tmp_path):
    src = tmp_path / "rollouts"
    for step in range(3):
        spark.range(30).select(F.lit(step).alias("step"), (F.col("id") % 3).alias("cluster"), F.floor(F.col("id") / 3).alias("position"), (F.col("id") * (step + 3) % 10 > 4).cast("int").alias("ok")).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("step int, cluster long, position long, ok int").option("maxFilesPerTrigger", 1).parquet(str(src))
    live = Scheduler({0: 40, 1: 40, 2: 40}, batch=10, active=2)
    seen = []
    q = R.fold_schedule(stream, live, "cluster", "position", F.col("ok"), str(tmp_path / "state"), str(tmp_path / "c"), after=lambda s: seen.append(s.steps))
    q.awaitTermination(120)
    assert seen == [1, 2, 3]
    plain = Scheduler({0: 40, 1: 40, 2: 40}, batch=10, active=2)
    from tessella.operators.scheduler import run_step

    for step in sorted({r.step for r in spark.read.parquet(str(src)).select("step").distinct().collect()}):
        run_step(plain, spark.read.parquet(str(src)).where(f"step = {step}"), "cluster", "position", F.col("ok"))
    assert plain.steps == live.steps and abs(sum(live.prob.values()) - 1) < 1e-9

"""Streams of rollout samples: bounded buffers, staleness, assembly of steps, a replay ring, and the schedule as a fold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from tessella.operators.scheduler import Scheduler, run_step


def keep_last(df: DataFrame, queue: str, order: str, capacity: int) -> DataFrame:
    """What a bounded queue that drops its oldest entries holds after all rows: the last `capacity` of each queue."""
    w = Window.partitionBy(queue).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= capacity).drop("_r")


def queue_stats(df: DataFrame, queue: str, capacity: int, consumed: Column) -> DataFrame:
    """Produced, consumed, dropped and waiting entries of each queue."""
    per = df.groupBy(queue).agg(F.count(F.lit(1)).alias("produced"), F.count_if(consumed).alias("consumed"))
    waiting = F.least(F.col("produced") - F.col("consumed"), F.lit(capacity))
    return per.withColumn("waiting", waiting.cast("long")).withColumn("dropped", F.col("produced") - F.col("consumed") - F.col("waiting"))


def staleness(df: DataFrame, current: Column, version: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(current - version >= 1).alias("n_stale"), F.max(current - version).alias("max_lag"))


def queue_capacity(required: int, threshold: float, sync_steps: int) -> int:
    return int(required * (threshold + 1) * sync_steps)


def assemble(indexed: DataFrame, required: int, idx: str = "row_idx") -> DataFrame:
    """Number the steps: every `required` samples in order of arrival make one; `complete` is false for a short last one."""
    df = indexed.withColumn("step", F.floor(F.col(idx) / required).cast("long"))
    return df.withColumn("complete", F.count(F.lit(1)).over(Window.partitionBy("step")) == required)


def replay_ring(df: DataFrame, order: str, capacity: int) -> DataFrame:
    """Contents of a ring after all rows: slot = order mod capacity, the latest row of each slot. order counts from 0."""
    slot = F.pmod(F.col(order), F.lit(capacity))
    columns = [c for c in df.columns if c != order]
    return df.groupBy(slot.alias("slot")).agg(F.max_by(F.struct(order, *columns), order).alias("_r")).select("slot", f"_r.{order}", *[f"_r.{c}" for c in columns])


def replay_sample(ring: DataFrame, n: int, seed: int) -> DataFrame:
    """n slots of a ring, uniformly and without replacement (all, if there are fewer), in a seeded order."""
    from tessella.operators.curriculum import sample_rows

    return sample_rows(ring, "slot", n, seed)


def snapshot_steps(df: DataFrame, step: str, interval: int) -> DataFrame:
    return df.where((F.col(step) <= 0) | (F.col(step) % interval == 0))


def bounded_buffer(stream: DataFrame, key: str, order: str, payload: str, capacity: int) -> DataFrame:
    """Stateful stream operator: the last `capacity` entries of each key, drop-oldest, with produced and dropped counts.

    State per key is bounded by the capacity; a row per key and micro-batch is emitted.
    """
    kinds = dict(stream.dtypes)

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, produced, dropped = state.get if state.exists else ([], 0, 0)
        held = list(held)
        for pdf in batches:
            pdf = pdf.sort_values(order, kind="stable")
            held += pdf[payload].tolist()
            produced += len(pdf)
        extra = max(0, len(held) - capacity)
        held, dropped = held[extra:], dropped + extra
        state.update((held, produced, dropped))
        yield pd.DataFrame({key: [keys[0]], "held": [held], "produced": [produced], "dropped": [dropped]})

    return stream.groupBy(key).applyInPandasWithState(
        run, f"{key} {kinds[key]}, held array<{kinds[payload]}>, produced long, dropped long", f"held array<{kinds[payload]}>, produced long, dropped long", "update", "NoTimeout"
    )


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time tumbling windows with a watermark, per key."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def fold_schedule(stream: DataFrame, scheduler: Scheduler, cluster: str, position: str, correct: Column, state_path: str, checkpoint: str, after: Callable[[Scheduler], None] | None = None) -> StreamingQuery:
    """Each micro-batch is one step: its rollouts update the schedule, whose state is written after every step.

    The state holds the id of the last batch folded in, so a batch that is run again after a failure counts once.
    """
    import json

    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        try:
            last = spark.read.text(state_path, wholetext=True).first()
        except Exception as e:  # no state yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        if last is not None:
            saved = json.loads(last[0])
            if saved["batch_id"] >= batch_id:
                return
            scheduler.__dict__.update(Scheduler.restore(saved["scheduler"]).__dict__)
        run_step(scheduler, batch, cluster, position, correct)
        text = json.dumps({"batch_id": batch_id, "scheduler": scheduler.save()})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(state_path)
        if after:
            after(scheduler)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Sharding by a keyed permutation of global row numbers (native).

The permutation is an unbalanced Feistel network over Z_a x Z_b with a*b just above the number of rows n; values that
land in [n, a*b) walk on along their cycle until they are below n. Shard and slot follow from the permuted number by
arithmetic, so any row's place can be computed without looking at another row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROUNDS = 6
#: Row numbering goes through so many hash buckets; their counts are the only table that is broadcast.
NUMBERING_BUCKETS = 4096


def _network(x: Column, a: Column, b: Column, key: Column) -> Column:
    """One pass of the network. Even rounds change the left half, odd rounds the right half."""
    start = F.struct((x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))

    def round_(s: Column, k: Column) -> Column:
        left, right = s["l"], s["r"]
        even = F.struct(F.pmod(left + F.pmod(F.xxhash64(key, k, right), a), a).alias("l"), right.alias("r"))
        odd = F.struct(left.alias("l"), F.pmod(right + F.pmod(F.xxhash64(key, k, left), b), b).alias("r"))
        return F.when(k % 2 == 0, even).otherwise(odd)

    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, start, round_, lambda s: s["l"] * b + s["r"])


def permute(x: Column, n: Column, key: Column) -> Column:
    """A permutation of 0..n-1 at x, for 0 <= x < n < 2**52; key selects the permutation.

    a*b - n < a, so a walk starts for about one row in sqrt(n), and it ends after at most a*b - n + 1 steps, because a
    cycle that starts below n meets each value of [n, a*b) once at most. The walk is thus exact, not cut short.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1))
    b = F.greatest(F.ceil(n / a).cast("long"), F.lit(1))
    once = _network(x, a, b, key)
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(a * b - n, F.lit(0)))
    return F.when(once < n, once).otherwise(
        F.aggregate(steps, once, lambda y, _: F.when(y < n, y).otherwise(_network(y, a, b, key)))
    )


def number_rows(rows: DataFrame, key_col: str, tie_cols: list[str], out: str = "row_no", total: str = "n_rows") -> DataFrame:
    """Gapless global row numbers from 0, without a sort of all rows in one task.

    Rows go to NUMBERING_BUCKETS buckets by a hash of the key (where it is null, of the tie columns) and are numbered
    within; the buckets' counts, a table of bounded size, give the offsets. The numbering depends on the rows only, not on their partitions. Rows equal in key
    and tie columns are interchangeable. rows must not have columns called _bucket, _offset, `out` or `total`.
    """
    of = F.xxhash64(F.lit("row number"), F.col(key_col))
    if tie_cols:
        of = F.when(F.col(key_col).isNull(), F.xxhash64(F.lit("row number"), *[F.col(c) for c in tie_cols])).otherwise(of)
    bucket = F.pmod(of, F.lit(NUMBERING_BUCKETS)).cast("int")
    counts = rows.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias(total),
    )
    within = Window.partitionBy("_bucket").orderBy(key_col, *tie_cols)
    return (
        rows.withColumn("_bucket", bucket)
        .withColumn("_rank", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.col("_offset") + F.col("_rank"))
        .drop("_bucket", "_offset", "_rank")
    )


def shard_rows(docs: DataFrame, n_shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents into shards in a reproducible shuffled order; law `rows`: counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32 (a null text counts as
    empty: 0), law, shard, slot (position within the shard, gapless from 0) and grown_shard (null under this law).
    A null doc_id is numbered like any other value; repeated rows each get their own slot; an empty table gives no rows.
    Other columns of docs are not read, so their names can't clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = permute(F.col("row_no"), F.col("n_rows"), F.lit(seed).cast("long"))
    return (
        number_rows(light, "doc_id", ["size", "text_crc32"])
        .withColumn("_place", placed)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.pmod("_place", F.lit(n_shards)).cast("int").alias("shard"),
            F.floor(F.col("_place") / n_shards).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

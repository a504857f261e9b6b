"""Relational batch algebra: a batch is a DataFrame whose row order is an explicit column.

Spark has no row order, so every operator that addresses rows by position takes the ordering columns, or a row index
made by `with_row_index`. No operator sorts all rows in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.session import cut_lineage


def with_row_index(df: DataFrame, *order: str, out: str = "row_idx") -> DataFrame:
    """Add gapless positions from 0 in the given order (which should be total: ties keep no promise).

    Rows are range-partitioned and sorted; a row's position is its place in its partition plus the rows of the
    partitions before. The sorted rows are checkpointed, so the places can't change when a partition is read again. Only
    the partitions' counts come to the driver.
    """
    placed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = cut_lineage(placed.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["_pid"], r["n"]) for r in placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for pid, n in counts:
        before[pid] = total
        total += n
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_pid")) if before else F.lit(0)
    return placed.withColumn(out, (F.col("_at") + offset).cast("long")).drop("_pid", "_at")


def first_rows(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first k rows in a total order, k being of any size: rows are numbered, not brought into one task."""
    return with_row_index(df, *order, out="_first").where(F.col("_first") < k).drop("_first")


def running_total(df: DataFrame, value: Column, *order: str, out: str = "total") -> DataFrame:
    """Sum of value over all rows up to each, in the given order: within ranges of the order, plus the ranges before."""
    placed = df.withColumn("_value", value).repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    placed = cut_lineage(placed.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before, total = [], 0.0
    for r in sorted(placed.groupBy("_pid").agg(F.sum("_value").alias("s")).collect(), key=lambda r: r["_pid"]):  # a row for each partition
        before.append((r["_pid"], total))
        total += float(r["s"] or 0)
    offsets = df.sparkSession.createDataFrame(before, "_p int, _before double")
    own = Window.partitionBy("_pid").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_own", F.sum("_value").over(own)).join(F.broadcast(offsets), F.col("_pid") == F.col("_p"))  # a row for each partition
    return summed.withColumn(out, F.col("_before") + F.col("_own")).drop("_value", "_pid", "_at", "_p", "_before", "_own")


def exact_quantiles(df: DataFrame, value: Column, quantiles: dict[str, float]) -> DataFrame:
    """One row with exact quantiles, linear between neighbours, by name; nulls are left out. Values are numbered, not collected."""
    indexed = with_row_index(df.select(value.cast("double").alias("v")).where("v is not null"), "v")
    n = indexed.count()
    low = {k: int(q * (n - 1)) for k, q in quantiles.items()}
    at = lambda i: F.max(F.when(F.col("row_idx") == i, F.col("v")))
    wanted = sorted({j for i in low.values() for j in (i, i + 1)})
    picked = [(at(low[k]) + (F.coalesce(at(low[k] + 1), at(low[k])) - at(low[k])) * (q * (n - 1) - low[k])).alias(k) for k, q in quantiles.items()]
    return indexed.where(F.col("row_idx").isin(wanted)).agg(*picked)


def select_columns(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keep the named columns; None keeps all."""
    if keys is None:
        return df
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")
    return df.select(*keys)


def pop_columns(df: DataFrame, keys: list[str], keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split columns out: (the popped, the rest); `keep` (the row key) stays in both."""
    popped = select_columns(df, [*keep, *keys])
    return popped, df.drop(*[k for k in keys if k not in keep])


def rename_columns(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("old and new names must be as many")
    return df.withColumnsRenamed(dict(zip(old, new)))


def take_rows(indexed: DataFrame, positions: DataFrame, idx: str = "row_idx", out: str = "out_pos") -> DataFrame:
    """Gather: positions has (out_pos, row_idx); order and duplicates are kept, positions out of range are an error upstream."""
    return indexed.join(positions.select(out, F.col(idx)), idx)


def mask_rows(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(F.coalesce(mask, F.lit(False)))


def slice_rows(indexed: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, idx: str = "row_idx") -> DataFrame:
    """Python slice semantics over the row index, negatives included (the number of rows is then counted first)."""
    if step < 1:
        raise ValueError("step must be at least 1")
    if (start or 0) < 0 or (stop if stop is not None else 0) < 0:
        n = indexed.count()
        start = max(0, n + start) if start is not None and start < 0 else start
        stop = max(0, n + stop) if stop is not None and stop < 0 else stop
    lo, i = start or 0, F.col(idx)
    kept = indexed.where(i >= lo)
    if stop is not None:
        kept = kept.where(i < stop)
    return kept if step == 1 else kept.where((i - lo) % step == 0)


def inverse_permutation(perm: DataFrame, pos: str = "pos", idx: str = "idx") -> DataFrame:
    """out[idx[i]] = i."""
    return perm.select(F.col(idx).alias(pos), F.col(pos).alias(idx))


def union_batches(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Put two batches side by side. Both must have the same rows, and columns that both have must agree in every row (NaN
    equals NaN); a row that one batch lacks, or a difference, is an error when run."""
    common = [c for c in b.columns if c in a.columns and c not in on]
    right = b.select(*on, *[c for c in b.columns if c not in a.columns], *[F.col(c).alias(f"_b_{c}") for c in common], F.lit(True).alias("_in_b"))
    out = a.withColumn("_in_a", F.lit(True)).join(right, on, "full")

    def checked(c: str, fine: Column, message: str) -> Column:
        return F.when(fine, F.col(c)).otherwise(F.raise_error(F.lit(message)).cast(out.schema[c].dataType))

    for c in common:
        out = out.withColumn(c, checked(c, F.col(c).eqNullSafe(F.col(f"_b_{c}")) | F.col("_in_a").isNull() | F.col("_in_b").isNull(), f"batches differ in {c}"))
    out = out.withColumn(on[0], checked(on[0], F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull(), "batches are not of the same rows"))
    return out.drop("_in_a", "_in_b", *[f"_b_{c}" for c in common])


def union_meta(a: dict, b: dict) -> dict:
    """Meta information of two batches together; a key that both have must have equal values (NaN equals NaN)."""
    for k in a.keys() & b.keys():
        if a[k] != b[k] and not (a[k] != a[k] and b[k] != b[k]):
            raise ValueError(f"meta information differs in {k!r}")
    return a | b


def union_meta_tables(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """union_meta for tables of keys and values, whose conflicts are errors when run."""
    j = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), key, "full")
    fine = F.col("_a").eqNullSafe(F.col("_b")) | F.col("_in_a").isNull() | F.col("_in_b").isNull()
    failed = F.raise_error(F.concat(F.lit("meta information differs in "), F.col(key).cast("string"))).cast(a.schema[value].dataType)
    return j.select(key, F.when(~fine, failed).otherwise(F.when(F.col("_in_a"), F.col("_a")).otherwise(F.col("_b"))).alias(value))


def get_item(indexed: DataFrame, item, idx: str = "row_idx") -> DataFrame:
    """Rows by a slice, an integer (one row, negative ones from the end), a list of integers (gathered in that order, as
    out_pos) or a list of booleans (a mask of all rows); anything else is a TypeError. Lists come from the driver: they
    are as long as the caller's."""
    if isinstance(item, slice):
        return slice_rows(indexed, item.start, item.stop, item.step or 1, idx)
    if hasattr(item, "tolist"):
        item = item.tolist()
    if isinstance(item, int) and not isinstance(item, bool):
        n = indexed.count() if item < 0 else 0
        return indexed.where(F.col(idx) == item + n)
    if isinstance(item, list) and item and all(isinstance(x, bool) for x in item):
        if len(item) != indexed.count():
            raise ValueError("a mask must be as long as the batch")
        item = [i for i, x in enumerate(item) if x]
    elif not (isinstance(item, list) and all(isinstance(x, int) for x in item)):
        raise TypeError(f"can't index a batch by {type(item).__name__}")
    n = indexed.count() if any(i < 0 for i in item) else 0
    rows = [(p, i + n if i < 0 else i) for p, i in enumerate(item)]
    return take_rows(indexed, indexed.sparkSession.createDataFrame(rows, f"out_pos long, {idx} long"), idx)


def replay_rows(indexed: DataFrame, positions: DataFrame, times: int, generated: DataFrame, idx: str = "row_idx") -> DataFrame:
    """The rows at `positions` (out_pos, row_idx), each `times` times in place (aabb), side by side with `generated`
    (out_idx, ..): as many rows as that, or an error when run."""
    rows = repeat_rows(take_rows(indexed, positions, idx), times, idx="out_pos", out="out_idx")
    return union_batches(rows, generated, ["out_idx"])


def with_defaults(df: DataFrame, extra: str, defaults: dict[str, Column]) -> DataFrame:
    """Add a column for each field of the struct `extra` that is named; its default stands in where the field or the value is missing."""
    have = {f.name for f in df.schema[extra].dataType.fields}
    return df.withColumns({k: F.coalesce(F.col(f"{extra}.{k}"), d) if k in have else d for k, d in defaults.items()})


def conflicts(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Per shared column, the number of rows in which two batches differ (null and NaN equal themselves)."""
    j = a.select(*on, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(*on, *[F.col(c).alias(f"b_{c}") for c in columns]), on)
    counts = j.agg(*[F.count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "n_conflicts")


def concat_batches(batches: list[DataFrame]) -> DataFrame:
    """One below the other, by name; columns that a batch lacks are null there. `batch_no` says which it was."""
    tagged = [b.withColumn("batch_no", F.lit(i)) for i, b in enumerate(batches)]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)


def append_rows(df: DataFrame, new: DataFrame, length: Column, most: int) -> DataFrame:
    """df with those new rows that aren't longer than `most` (a null length is too long)."""
    return df.unionByName(new.where(F.coalesce(length <= most, F.lit(False))))


def repeat_rows(indexed: DataFrame, times: int, interleave: bool = True, n_rows: Column | None = None, idx: str = "row_idx", out: str = "out_idx") -> DataFrame:
    """Each row `times` times: aabb if interleaved, abab otherwise (then the number of rows is needed)."""
    if not interleave and n_rows is None:
        n_rows = F.lit(indexed.count())
    df = indexed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    place = F.col(idx) * times + F.col("copy") if interleave else F.col("copy") * n_rows + F.col(idx)
    return df.withColumn(out, place.cast("long"))


def repeat_by(df: DataFrame, count: Column) -> DataFrame:
    """Each row as often as its count says; rows with 0 go."""
    return df.withColumn("_n", count.cast("int")).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")


def chunk_rows(indexed: DataFrame, n: int, n_rows: int, idx: str = "row_idx", out: str = "chunk") -> DataFrame:
    """n equal chunks; an error if the rows can't be divided."""
    if n_rows % n:
        raise ValueError(f"{n_rows} rows can't be divided by {n}; pad first")
    return indexed.withColumn(out, F.floor(F.col(idx) / (n_rows // n)).cast("int"))


def split_rows(indexed: DataFrame, size: int, idx: str = "row_idx", out: str = "part") -> DataFrame:
    """Parts of `size` rows, the last one shorter."""
    return indexed.withColumn(out, F.floor(F.col(idx) / size).cast("int"))


def pad_to_divisor(indexed: DataFrame, divisor: int, n_rows: int, idx: str = "row_idx") -> DataFrame:
    """Append rows from the start, in a cycle, until the divisor divides the number of rows; `padded` marks them."""
    pad = -n_rows % divisor if n_rows else 0
    own = indexed.withColumn("padded", F.lit(False))
    if not pad:
        return own
    again = F.sequence(F.col(idx), F.lit(pad - 1).cast("long"), F.lit(n_rows).cast("long"))
    more = indexed.where(F.col(idx) < pad).withColumn("_k", F.explode(again)).withColumn(idx, F.lit(n_rows) + F.col("_k")).drop("_k")
    return own.unionByName(more.withColumn("padded", F.lit(True)))


def pad_with_row(indexed: DataFrame, n: int, n_rows: int, which: str = "first", idx: str = "row_idx") -> DataFrame:
    """Append n copies of the first or the last row."""
    row = indexed.where(F.col(idx) == (0 if which == "first" else n_rows - 1))
    more = row.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(idx, F.lit(n_rows) + F.col("_k")).drop("_k") if n else row.limit(0)
    return indexed.unionByName(more)


def contiguous_shards(indexed: DataFrame, n: int, n_rows: int, idx: str = "row_idx", out: str = "shard") -> DataFrame:
    """Contiguous shards whose sizes differ by one at most, the larger ones first."""
    q, r = divmod(n_rows, n)
    i = F.col(idx)
    place = F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / max(q, 1)))
    return indexed.withColumn(out, place.cast("int"))


def collate(indexed: DataFrame, size: int, columns: list[str], idx: str = "row_idx") -> DataFrame:
    """Rows to columns: a row for each batch of `size` rows, with an array for each column, in order."""
    entry = F.struct(idx, *columns)
    grouped = indexed.groupBy(F.floor(F.col(idx) / size).cast("long").alias("batch_id")).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    return grouped.select("batch_id", *[F.col("_rows")[c].alias(c) for c in columns])


def unfold_chunks(df: DataFrame, column: str, n: int) -> DataFrame:
    """Cut an array column into n equal parts, a row for each."""
    width = F.floor(F.size(column) / n).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(F.col(column), i * width + 1, width))
    return df.select("*", F.posexplode(parts).alias("part", f"{column}_part"))


def zigzag_order(n_rows: Column, idx: Column) -> Column:
    """Position of row idx when rows are laid out as [::2] + [1::2][::-1]: small ends outwards."""
    evens = F.floor((n_rows + 1) / 2)
    return F.when(idx % 2 == 0, F.floor(idx / 2)).otherwise(evens + F.floor(n_rows / 2) - 1 - F.floor(idx / 2)).cast("long")


def shuffled_mini_batches(df: DataFrame, key: str, size: int, seed: int, epochs: int = 1) -> DataFrame:
    """Seeded order by hash for each epoch, cut into mini-batches."""
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    out = out.withColumn("_h", F.xxhash64(F.lit(seed), "epoch", key))
    indexed = with_row_index(out, "epoch", "_h", key, out="_i")
    n = df.count()
    return indexed.withColumn("place", F.col("_i") - F.col("epoch") * n).withColumn("mini_batch", F.floor(F.col("place") / size).cast("int")).drop("_h", "_i")


def head_rows(indexed: DataFrame, n: int, idx: str = "row_idx") -> DataFrame:
    """The first n rows; n <= 0 keeps all."""
    return indexed if n <= 0 else indexed.where(F.col(idx) < n)


def runs_of(df: DataFrame, value: str, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """Number runs of equal neighbours (gaps and islands) within each partition."""
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

"""All pairs within groups, in blocks of bounded size.

A group of up to 2 * BLOCK rows is one block. A larger one is dealt by a hash into chunks of about BLOCK rows, and each
unordered pair of chunks is a block of its own, so no task ever holds more than two chunks: the exact way for groups of
any size. Rows of one block arrive next to each other in one partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def in_blocks(rows: DataFrame, group: list[str], size_col: str, id_col: str) -> DataFrame:
    """Add _i, _j (the block's chunks) and _c (the row's chunk) and bring each block's rows together, sorted by block.

    size_col holds the size of the row's group. Pairs to look at: both rows if _i = _j, one of each chunk otherwise.
    """
    k = F.when(F.col(size_col) <= 2 * BLOCK, F.lit(1)).otherwise(F.ceil(F.col(size_col) / BLOCK)).cast("int")
    own = rows.withColumn("_k", k).withColumn("_c", F.pmod(F.xxhash64(F.lit("chunk"), F.col(id_col)), F.col("_k")).cast("int"))
    own = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    own = own.withColumn("_i", F.least("_c", "_o")).withColumn("_j", F.greatest("_c", "_o")).drop("_o", "_k")
    return own.repartition(*group, "_i", "_j").sortWithinPartitions(*group, "_i", "_j")


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Split a stream sorted by integer keys into the tables of rows of equal key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [np.asarray(batch.column(k)) for k in key]
        new = np.zeros(n, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            new[0] = any(last.column(k)[last.num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in key)
        cut = [*np.flatnonzero(new).tolist(), n]
        at = 0
        for c in cut:
            if c > at:
                held.append(batch.slice(at, c - at))
            if c < n and held:
                yield pa.Table.from_batches(held)
                held = []
            at = c
    if held:
        yield pa.Table.from_batches(held)


def pairs_of(i: int, j: int, chunk: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places a < b of the true cells of a square mask that this block has to look at."""
    mask = np.triu(mask, 1)
    if i != j:
        mask &= chunk[:, None] != chunk[None, :]
    return np.nonzero(mask)


def label(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id of each place's component under the links (a, b)."""
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        if (low == before).all():
            return low

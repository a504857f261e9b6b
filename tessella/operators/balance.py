"""Balancing of variable-length work over workers and micro-batches.

The differencing method is sequential in one batch, whose size is a parameter of training and not of the data, so each
batch is one group of applyInPandas; batches are independent of each other.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differencing(work: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Karmarkar-Karp k-way partition of items 0..n-1: the two partial solutions of greatest spread merge, opposed.

    With equal_size all parts have n / k items (k must divide n): items enter in groups of k neighbours in size.
    """
    n = len(work)
    if equal_size and n % k:
        raise ValueError("k must divide the number of items")
    order = sorted(range(n), key=lambda i: (work[i], i))
    starts = [order[i : i + k] for i in range(0, n, k)] if equal_size else [[i] for i in order]
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for tag, items in enumerate(starts):
        parts = sorted([(work[i], [i]) for i in items] + [(0, []) for _ in range(k - len(items))], key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], tag, parts))
    tag = len(starts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], tag, merged))
        tag += 1
    return [sorted(p) for _, p in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy(work: list[int], k: int) -> list[list[int]]:
    """Largest first, each to the lightest part."""
    heap = [(0, i) for i in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i in sorted(range(len(work)), key=lambda i: (-work[i], i)):
        load, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (load + work[i], p))
    return [sorted(p) for p in parts]


def cost(n: int) -> int:
    return 24576 * n + n * n


def micro_batches(lengths: list[int], max_tokens: int) -> list[list[int]]:
    """min(n, ceil(tokens / max_tokens)) micro-batches by cost, the cheapest ones at both ends."""
    count = max(1, min(len(lengths), -(-sum(lengths) // max_tokens)))
    parts = sorted(differencing([cost(x) for x in lengths], count), key=lambda p: (-sum(cost(lengths[i]) for i in p), p))
    return parts[::2][::-1] + parts[1::2] if len(parts) > 2 else parts


def grouped_partition(lengths: list[int], uids: list, k: int) -> list[list[int]]:
    """Partition that keeps the rows of a run of equal uid together."""
    runs: list[list[int]] = []
    for i, u in enumerate(uids):
        if runs and uids[runs[-1][-1]] == u:
            runs[-1].append(i)
        else:
            runs.append([i])
    if len(runs) < k:
        raise ValueError("fewer groups than parts")
    parts = differencing([sum(cost(lengths[i]) for i in r) for r in runs], k)
    return [sorted(i for r in p for i in runs[r]) for p in parts]


def balance_batches(df: DataFrame, batch: str, key: str, length: str, k: int, equal_size: bool = True) -> DataFrame:
    """(batch, key, length, part, place): each batch's rows dealt to k parts of near equal cost, short rows at both ends."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        parts = differencing([cost(int(x)) for x in pdf[length]], k, equal_size and len(pdf) % k == 0)
        out = []
        for p, items in enumerate(parts):
            items = sorted(items, key=lambda i: (int(pdf[length][i]), i))
            out += [(i, p, place) for place, i in enumerate(items[::2] + items[1::2][::-1])]
        at = pd.DataFrame(out, columns=["i", "part", "place"])
        return pd.concat([pdf.loc[at["i"], [batch, key, length]].reset_index(drop=True), at[["part", "place"]]], axis=1)

    return df.select(batch, key, length).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {key} {kinds[key]}, {length} {kinds[length]}, part int, place int")


def _numbered(df: DataFrame, batch: str, key: str, columns: list[str], parts_of) -> DataFrame:
    """(batch, key, part, place): the rows of each batch, in order of key, dealt by parts_of(rows)."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        rows = [(pdf[batch][i], pdf[key][i], p, place) for p, items in enumerate(parts_of(pdf)) for place, i in enumerate(items)]
        return pd.DataFrame(rows, columns=[batch, key, "part", "place"])

    return df.select(batch, key, *columns).groupBy(batch).applyInPandas(run, f"{batch} {kinds[batch]}, {key} {kinds[key]}, part int, place int")


def micro_batch_rows(df: DataFrame, batch: str, key: str, length: str, max_tokens: int) -> DataFrame:
    """Each batch's rows in micro-batches (see micro_batches)."""
    return _numbered(df, batch, key, [length], lambda pdf: micro_batches([int(x) for x in pdf[length]], max_tokens))


def grouped_rows(df: DataFrame, batch: str, key: str, uid: str, length: str, k: int) -> DataFrame:
    """Each batch's rows in k parts that keep runs of equal uid together (see grouped_partition)."""
    return _numbered(df, batch, key, [uid, length], lambda pdf: grouped_partition([int(x) for x in pdf[length]], pdf[uid].tolist(), k))


def unbalance(df: DataFrame, length: str, part: str) -> DataFrame:
    """Least, greatest and mean load of the parts, and their difference."""
    per = df.groupBy(part).agg(F.sum(length).alias("n"))
    return per.agg(F.min("n").alias("min"), F.max("n").alias("max"), (F.max("n") - F.min("n")).alias("diff"), F.avg("n").alias("mean"))

"""Near-duplicate vectors through spherical-cap filters with structured random product codes.

A vector is rotated at random and cut into two halves; each half has a codebook of C random unit directions. The C * C
pairs of codewords are the filter directions. A vector belongs to every filter whose direction it exceeds the threshold
in; these are listed by pruned enumeration of the product, without a look at all C * C.

A filter's post is light: the vector's number, 128 signs of random projections and the filters that it is in before this
one. Within a filter, signs leave out pairs that are clearly apart, and the lists those that share an earlier filter:
each pair is looked at in the least filter that both have. Only vectors with a pair left are then joined to their
components, once for each filter where they have one, and compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.blocks import BLOCK, in_blocks, label, pairs_of, runs
from tessella.llm.components import compact, components
from tessella.llm.words import frugal
from tessella.session import cut_lineage

#: Filters that a vector is in on average, and at least.
LIST, LEAST = 10, 8
#: Vectors that a filter should hold; it sets the codebook's size, within the bounds.
LOAD, MIN_CODES, MAX_CODES = 256, 8, 16_384
#: Vectors (least by a hash of the id) that the threshold is fitted on; every vector is indexed.
SAMPLE = 256
SIGNS = 128


@lru_cache(maxsize=4)
def _code(dim: int, codes: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation and the two codebooks."""
    rng = np.random.default_rng([seed, dim, codes])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = max(1, dim // 2)
    books = []
    for d in (half, max(1, dim - half)):
        b = rng.standard_normal((codes, d))
        books.append(b / np.linalg.norm(b, axis=1, keepdims=True) / math.sqrt(2))
    return turn, books[0], books[1]


def _scores(x: np.ndarray, codes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    dim = x.shape[1]
    turn, first, second = _code(dim, codes, seed)
    y = x @ turn
    half = first.shape[1]
    if dim == 1:
        return y @ first.T, np.zeros((len(x), codes))
    return y[:, :half] @ first.T, y[:, half:] @ second.T


def decode(x: np.ndarray, codes: int, alpha: float, seed: int) -> list[np.ndarray]:
    """For each row of x (of length 1), the sorted filters whose direction it exceeds alpha in, or its LEAST best ones if more.

    The LEAST best sums of two sorted lists lie among the first LEAST of each, so the threshold that admits them comes
    from a small square; codewords that can't reach the threshold with the other half's best are then left out.
    """
    out: list[np.ndarray] = []
    top = min(LEAST, codes)
    for lo in range(0, len(x), 1024):
        one, two = _scores(x[lo : lo + 1024], codes, seed)
        order1, order2 = np.argsort(-one, axis=1), np.argsort(-two, axis=1)
        one, two = np.take_along_axis(one, order1, 1), np.take_along_axis(two, order2, 1)
        best = (one[:, :top, None] + two[:, None, :top]).reshape(len(one), -1)
        floor = -np.partition(-best, top - 1, axis=1)[:, top - 1]
        limit = np.minimum(alpha, floor) - 1e-12
        k1 = int((one + two[:, :1] >= limit[:, None]).sum(1).max())
        k2 = int((two + one[:, :1] >= limit[:, None]).sum(1).max())
        row, i, j = np.nonzero(one[:, :k1, None] + two[:, None, :k2] >= limit[:, None, None])
        filters = order1[row, i].astype(np.int64) * codes + order2[row, j]
        ends = np.cumsum(np.bincount(row, minlength=len(one)))
        out += [np.sort(f) for f in np.split(filters, ends[:-1])]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision. The greatest component is divided out first: squares can't leave the range."""
    x = np.asarray(x, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return _unit(np.asarray(column.flatten()).reshape(-1, dim))


def _signs(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows x 2 words of 64 signs."""
    planes = np.random.default_rng([seed, x.shape[1], SIGNS]).standard_normal((x.shape[1], SIGNS))
    return np.packbits(x @ planes > 0, axis=1).view("<i8")


def _most_apart(threshold: float) -> int:
    """Signs that a pair at the threshold differs in at most, but for one in 10**8 (six standard deviations)."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return min(SIGNS, math.ceil(SIGNS * p + 6 * math.sqrt(SIGNS * p * (1 - p))))


def _fit(sample: list, codes: int, seed: int) -> dict[int, float]:
    """By dimension, the threshold that puts a sampled vector into LIST filters on average."""
    out = {}
    for dim in {len(v) for v in sample}:
        one, two = _scores(_unit(np.unique(np.array([v for v in sample if len(v) == dim], dtype=np.float64), axis=0)), codes, seed)
        keep = min(codes, 256)  # sums beyond the best 256 of each half don't reach the threshold
        one, two = -np.sort(-one, axis=1)[:, :keep], -np.sort(-two, axis=1)[:, :keep]
        sums = np.concatenate([(one[r : r + 1].T + two[r : r + 1]).ravel() for r in range(len(one))])
        want = min(len(sums) - 1, LIST * len(one))
        out[dim] = float(-np.partition(-sums, want)[want])
    return out


def _first_common(row: np.ndarray, filters: np.ndarray, f: int, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which pairs (a, b) of a filter's rows share no filter before f. row and filters list the rows' filters.

    Filters before f that at least two rows have make a 0/1 matrix; its product with itself counts what a pair shares.
    """
    early = filters < f
    row, filters = row[early], filters[early]
    names, code, count = np.unique(filters, return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    keep = count[code] > 1
    width = int((count > 1).sum())
    shared = np.zeros(len(a), dtype=bool)
    for lo in range(0, width, 512):
        part = keep & (new[code] >= lo) & (new[code] < lo + 512)
        m = np.zeros((n, min(512, width - lo)), dtype=np.float32)
        m[row[part], new[code[part]] - lo] = 1
        if len(a) > 4 * n:
            shared |= (m @ m.T)[a, b] > 0.5
        else:
            shared |= np.einsum("ij,ij->i", m[a], m[b]) > 0.5
    return ~shared


def _close(most: int):
    """The rows of each block that have a pair to compare there: signs not too far apart, no earlier filter in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "_i", "_j"]):
            n = group.num_rows
            if n < 2:
                continue
            words = [np.asarray(group.column(c)).view(np.uint64) for c in ("s1", "s2")]
            mask = np.zeros((n, n), dtype=bool)
            for lo in range(0, n, 256):
                mask[lo : lo + 256] = sum(np.bitwise_count(w[lo : lo + 256, None] ^ w[None]).astype(np.int16) for w in words) <= most
            a, b = pairs_of(group.column("_i")[0].as_py(), group.column("_j")[0].as_py(), np.asarray(group.column("_c")), mask)
            if not len(a):
                continue
            at = np.unique(np.r_[a, b])
            lists = group.column("before").combine_chunks()
            size, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
            first = _first_common(np.repeat(np.arange(n), size), flat, 1 << 62, a, b, n)
            at = np.unique(np.r_[a[first], b[first]])
            if len(at):
                yield group.select(["key", "_i", "_j", "_c", "node"]).take(pa.array(at)).combine_chunks().to_batches()[0]

    return run


def _linked(threshold: float):
    """Links of each block, each pair in the first filter that both are in: of every row their number and the least node joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "_i", "_j"]):
            if group.num_rows < 2:
                continue
            key = group.column("key")[0].as_py()
            x = _matrix(group.column("x"), key >> 32)
            a, b = pairs_of(group.column("_i")[0].as_py(), group.column("_j")[0].as_py(), np.asarray(group.column("_c")), x @ x.T >= threshold)
            lists = group.column("filters").combine_chunks()
            size, flat = np.asarray(lists.value_lengths()), np.asarray(lists.flatten())
            if len(a):
                first = _first_common(np.repeat(np.arange(len(x)), size), flat, key & 0xFFFFFFFF, a, b, len(x))
                a, b = a[first], b[first]
            if len(a):
                nodes, copies = np.asarray(group.column("node")), np.asarray(group.column("copies"))
                low = label(len(nodes), a, b, nodes)
                links = (np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))).astype(np.int64)
                at = np.unique(np.r_[a, b])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(links[at]), pa.array(low[at])], ["node", "links", "low"])

    return run


def near_vectors(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, hold null or non-finite components, or have a null id link with nothing, nor
    do vectors of different length; a row without links is its own component (null for a null id) and kept. Lengths
    don't matter, from the least to the largest doubles. Equal vectors are compared once and count with their
    multiplicity, so a large group of copies costs as much as one vector. Ids are whole numbers; rows of equal id are
    vectors of their own. Other columns aren't read. An empty table gives no rows.
    """
    real = "float" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    empty, v = F.array().cast(f"array<{real}>"), F.col(vector_col).cast(f"array<{real}>")
    fine = F.col(id_col).isNotNull() & F.coalesce(
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    clean = rows.select(F.col(id_col).cast("long").alias("vec"), F.when(fine, v).otherwise(empty).alias("x"))
    keyed = clean.where(F.size("x") > 0).withColumn("k1", F.xxhash64(F.lit(1), "x")).withColumn("k2", F.xxhash64(F.lit(2), "x"))
    n = keyed.count()
    codes = min(MAX_CODES, max(MIN_CODES, math.ceil(math.sqrt(n * LIST / LOAD))))
    sample = [r["x"] for r in keyed.orderBy(F.xxhash64("vec"), "vec", "k1").select("x").limit(SAMPLE).collect()]
    alphas = _fit(sample, codes, seed)
    typical = next(iter(alphas.values()), 0.0)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("x").value_lengths())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                x = _matrix(part.column("x"), int(dim))
                lists, signs = decode(x, codes, alphas.get(int(dim), typical), seed), _signs(x, seed)
                ends = np.r_[0, np.cumsum([len(f) for f in lists])].astype(np.int32)
                flat = pa.array(np.concatenate(lists).astype(np.int32))
                new = [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(signs[:, 0].copy()), pa.array(signs[:, 1].copy())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("k1", "k2", "vec", "copies", "x")), *new], ["k1", "k2", "vec", "copies", "x", "filters", "s1", "s2"])

    distinct = keyed.groupBy("k1", "k2").agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    indexed = distinct.mapInArrow(frugal(index), f"k1 long, k2 long, vec long, copies long, x array<{real}>, filters array<int>, s1 long, s2 long")
    indexed = cut_lineage(indexed.withColumn("node", F.monotonically_increasing_id()))  # fixed from here on: the checkpoint is read, not made again
    key = F.shiftleft(F.size("x").cast("long"), 32).bitwiseOR(F.col("f").cast("long"))
    hot = indexed.select("x", F.explode("filters").alias("f")).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("load")).where(F.col("load") > 2 * BLOCK)
    posted = indexed.select("node", "s1", "s2", "x", "filters", F.posexplode("filters").alias("p", "f"))
    posted = posted.select(key.alias("key"), "node", "s1", "s2", F.slice("filters", F.lit(1), F.col("p")).alias("before"))
    sized = posted.join(hot, "key", "left").withColumn("load", F.coalesce("load", F.lit(1)))
    blocks = in_blocks(sized, ["key"], "load", "node").drop("load")
    close = compact(blocks.mapInArrow(frugal(_close(_most_apart(threshold))), "key long, _i int, _j int, _c int, node long"))
    full = close.join(indexed.select("node", "copies", "x", "filters"), "node").repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j")
    found = compact(full.mapInArrow(frugal(_linked(threshold)), "node long, links long, low long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = compact(components(found.select(F.col("node").alias("u"), F.col("low").alias("v"))))
    least = roots.join(indexed.select("node", "vec"), "node").groupBy("root").agg(F.min("vec").alias("least"))
    classes = (
        indexed.select("k1", "k2", "node", "vec", "copies")
        .join(counts, "node", "left")
        .join(roots.join(least, "root").select("node", "least"), "node", "left")
        .select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "vec").alias("component_id"))
    )
    return (
        clean.withColumn("k1", F.when(F.size("x") > 0, F.xxhash64(F.lit(1), "x")))
        .withColumn("k2", F.when(F.size("x") > 0, F.xxhash64(F.lit(2), "x")))
        .select("vec", "k1", "k2")
        .join(classes, ["k1", "k2"], "left")
        .select(
            F.col("vec").alias("vec_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec").alias("component_id"),
            F.coalesce(F.col("vec") == F.coalesce("component_id", "vec"), F.lit(True)).alias("kept"),
        )
    )

"""Vector operators on array columns: no UDF, all in higher-order functions or aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.batch import exact_quantiles


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def l2_normalize(a: Column, floor: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def mean_vectors(df: DataFrame, group: str | list[str], vector: str, weight: Column | None = None, dim: int | None = None) -> DataFrame:
    """Mean vector of each group (weighted by a mask if given), dimension by dimension, so partial sums happen before the shuffle.

    With the dimension known, one aggregate per dimension keeps the whole group in one row of sums: nothing is exploded.
    """
    keys = [group] if isinstance(group, str) else group
    w = weight.cast("double") if weight is not None else F.lit(1.0)
    if dim is not None:
        sums = [F.sum(F.get(F.col(vector), i).cast("double") * w).alias(f"_{i}") for i in range(dim)]
        base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.greatest(F.sum(w), F.lit(1e-6)).alias("_w"), *sums)
        return base.select(*keys, "n", F.array(*[F.col(f"_{i}") / F.col("_w") for i in range(dim)]).alias("centroid"))
    long = df.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_d", "_x")).groupBy(*keys, "_d").agg((F.sum(F.col("_x") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-6))).alias("_m"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return long.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_d", "_m"))), lambda s: s["_m"]).alias("centroid")).join(sizes, keys).select(*keys, "n", "centroid")


def norm_stats(df: DataFrame, vector: str) -> DataFrame:
    """Least, greatest, mean and population std of the norms, and exact percentiles with linear interpolation."""
    n = norm(F.col(vector))
    stats = df.select(n.alias("v")).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return stats.crossJoin(F.broadcast(exact_quantiles(df, n, {"p50": 0.5, "p95": 0.95, "p99": 0.99})))  # a row each


def embedding_checks(df: DataFrame, key: str, vector: str) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_ids"), F.min(F.size(vector)).alias("dim_min"), F.max(F.size(vector)).alias("dim_max"), F.count_if(bad).alias("n_bad")
    )


def last_token_pool(tokens: DataFrame, sample: str, pos: str, value: str, mask: Column) -> DataFrame:
    """The value at the index (number of unmasked tokens - 1, at least 0), counting tokens by position."""
    w = Window.partitionBy(sample)
    at = F.greatest(F.sum(mask.cast("int")).over(w) - 1, F.lit(0))
    return tokens.withColumn("_i", F.row_number().over(w.orderBy(pos)) - 1).withColumn("_at", at).where("_i = _at").select(sample, F.col(value).alias("pooled"))


def nearest_centroid(df: DataFrame, centroids: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Label and distance of the nearest centroid, ties to the lowest label.

    The centroids are collected into one array of a row (k is a parameter of the clustering, not of the data) and each
    vector walks it where it is: no row is multiplied and nothing is shuffled.
    """
    table = centroids.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("c"), F.col("centroid").alias("v")))).alias("_cs"))
    best = F.array_min(F.transform("_cs", lambda c: F.struct(distance(F.col(vector), c["v"]).alias("d"), c["c"].alias("c"))))
    return df.join(F.broadcast(table)).select(key, best.alias("_b")).select(key, F.col("_b.c").alias("cluster_id"), F.col("_b.d").alias("distance_to_centroid"))


#: Blocks of rows that a task of block_pairs holds, at most.
ROW_BLOCKS = 32


def block_pairs(queries: DataFrame, rows: DataFrame, key: str, query_block: int, row_block: int) -> DataFrame:
    """All pairs of a block of queries (q_b, q_ and each column) and a block of rows (r_ and each column), packed into a row
    each: columns are lists, `v` the vectors one after another. A block of queries meets its blocks of rows in turn.

    Blocks of queries are smaller where there would be fewer than cores. A task has one of them and at most ROW_BLOCKS of rows.
    """

    def packed(df: DataFrame, n: int, parts: int, name: str) -> DataFrame:
        own = df.withColumn("_b", F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n)))
        one = own.groupBy("_b").agg(F.collect_list(F.struct(*df.columns)).alias("_r"))
        lists = [(F.flatten("_r.v") if c == "v" else F.col(f"_r.{c}")).alias(f"{name}_{c}") for c in df.columns]
        return one.repartitionById(parts, F.col("_b").cast("int") % parts).select(F.col("_b").alias(f"{name}_b"), *lists)

    many, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-many // max(1, min(query_block, max(1024, -(-many // (3 * cores)))))))
    m = max(1, -(-rows.count() // row_block))
    return packed(queries, n, n, "q").crossJoin(packed(rows, m, -(-m // ROW_BLOCKS), "r").drop("r_b"))


def products(a, b):
    """(-2a, 1) and (b, |b|^2), whose product is the squared distance but for |a|^2, and of each row of a |a|^2 and what
    the product may be off by. Singles, unless the numbers don't fit them; what is near a bound has to be measured again."""
    import numpy as np

    sa, sb = (a * a).sum(1), (b * b).sum(1)
    top = max(sa.max(initial=0), sb.max(initial=0))
    kind = np.float32 if 1e-20 < top < 1e30 else np.float64
    slack = 4 * (a.shape[1] + 8) * np.finfo(kind).eps * (sa + sb.max(initial=0))
    return np.c_[-2 * a, np.ones(len(a))].astype(kind), np.ascontiguousarray(np.c_[b, sb].astype(kind).T), sa, slack


def measured(a, b, i, j):
    """Distances of rows i of a and j of b, in double precision."""
    import numpy as np

    return np.concatenate([np.zeros(0)] + [np.sqrt(((a[i[c : c + 65536]] - b[j[c : c + 65536]]) ** 2).sum(1)) for c in range(0, len(i), 65536)])


def knn(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, dim: int, query_block: int = 8192, row_block: int = 8192) -> DataFrame:
    """Exact k nearest neighbours by euclidean distance (to nine decimals, ties to the least key), self left out.

    Both sides are dealt into blocks of about query_block and row_block vectors. A block of queries meets blocks of rows one
    after another and keeps its k least; what a product in single precision can't rule out is measured in double precision.
    All pairs are looked at: the work is quadratic, the memory of a task is not. Any number of queries works.
    """
    import numpy as np
    import pyarrow as pa

    def look(ids, a, own, b, near, names):
        """Bring a block of rows into the k least (near: distances, names: keys) of a block of queries."""
        pa_, pb, sa, slack = products(a, b)
        for lo in range(0, len(ids), 256):
            at = slice(lo, lo + 256)
            d2 = pa_[at] @ pb
            kth = near[at, k - 1]
            new = np.isinf(kth)
            if new.any() and len(own) > k:
                low = np.partition(d2[new], k, axis=1)[:, k] + sa[at][new] + slack[at][new]  # one of these may be the query itself
                kth = kth.copy()
                kth[new] = np.sqrt(np.maximum(low, 0))
            most = (kth + 2e-9) ** 2 + slack[at] - sa[at]
            i, j = np.divmod(np.flatnonzero(d2 <= most[:, None].astype(d2.dtype)), len(own))
            other = ids[lo + i] != own[j]
            i, j = lo + i[other], j[other]
            if not len(i):
                continue
            d, some = measured(a, b, i, j), np.unique(i)
            q, d, n = np.r_[np.repeat(some, k), i], np.r_[near[some].ravel(), d], np.r_[names[some].ravel(), own[j]]
            order = np.lexsort((n, np.round(d, 9), q))
            q, d, n = q[order], d[order], n[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            first = place < k
            near[q[first], place[first]], names[q[first], place[first]] = d[first], n[first]

    def run(batches):
        def out():
            i, j = np.nonzero(np.isfinite(near))
            return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(names[i, j]), pa.array(near[i, j])], ["src", "dst", "distance"])

        block = None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, kind: np.asarray(batch.column(c)[r].values, dtype=kind)  # noqa: E731, B023
                if block != batch.column("q_b")[r].as_py():
                    if block is not None:
                        yield out()
                    block, ids, a = batch.column("q_b")[r].as_py(), get("q_k", np.int64), get("q_v", float).reshape(-1, dim)
                    ok = np.isfinite((a * a).sum(1))
                    ids, a = ids[ok], a[ok]
                    near, names = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
                own, b = get("r_k", np.int64), get("r_v", float).reshape(-1, dim)
                ok = np.isfinite((b * b).sum(1))
                look(ids, a, own[ok], b[ok], near, names)
        if block is not None:
            yield out()

    sides = [df.select(F.col(key).cast("long").alias("k"), as_vector(df, vector).alias("v")) for df in (queries, rows)]
    near = block_pairs(*sides, "k", query_block, row_block).mapInArrow(run, "src long, dst long, distance double")
    w = Window.partitionBy("src").orderBy(F.round("distance", 9), "dst")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_nearest(queries: DataFrame, rows: DataFrame, key: str, group: str, vector: str, k: int, dim: int, query_block: int = 8192, row_block: int = 8192) -> DataFrame:
    """(src, dst, cosine): the k rows of a query's group of the greatest cosine (to nine decimals, ties to the least key), self left out.

    Blocks as in knn; what a product in single precision can't rule out is measured as cosine() does. Where that is null, as
    for vectors of length 0, rows come last, and where it is NaN first.
    """
    import numpy as np
    import pyarrow as pa

    def dots(a, b):
        out = np.zeros(len(a))
        for x in range(dim):
            out += a[:, x] * b[:, x]
        return out

    def side(batch, r, name):
        get = lambda c, kind=None: np.asarray(batch.column(f"{name}_{c}")[r].values.to_numpy(zero_copy_only=False), dtype=kind)
        ids, groups, v = get("k", np.int64), get("g"), get("v", float).reshape(-1, dim)
        with np.errstate(all="ignore"):
            length = np.sqrt(dots(v, v))
            odd = ~(np.isfinite(length) & (length > 1e-150))
            unit = np.where(odd[:, None], 0, v / length[:, None]).astype(np.float32)
        if name == "r":  # of rows of length 0 no query takes more than k and itself, of a group
            order = np.lexsort((ids, length != 0, groups))
            zero, at = length[order] == 0, np.searchsorted(groups[order], groups[order])
            order = order[~zero | (np.arange(len(ids)) - at <= k)]
        else:
            order = np.argsort(groups, kind="stable")
        return ids[order], groups[order], v[order], length[order], odd[order], unit[order]

    slack = 4 * (dim + 8) * float(np.finfo(np.float32).eps)  # what a product may be off by

    def look(q, r, near, names, value):
        labels, first = np.unique(q[1], return_index=True)
        lows, highs = np.searchsorted(r[1], labels, "left"), np.searchsorted(r[1], labels, "right")
        for start, end, x, y in zip(first, [*first[1:], len(q[1])], lows, highs):
            if x == y:
                continue
            for lo in range(start, end, 256):
                at = slice(lo, min(lo + 256, end))
                less = -(q[5][at] @ r[5][x:y].T)
                less[q[4][at]] = -np.inf
                less[:, r[4][x:y]] = -np.inf
                kth = near[at, k - 1]
                new = np.isinf(kth) & (kth > 0)
                if new.any() and y - x > k:
                    kth = kth.copy()
                    low = np.partition(less[new], k, axis=1)[:, k]  # one of these may be the query itself
                    odds = int(r[4][x:y].sum())  # of which nothing is known, so they don't count
                    if odds and y - x > k + odds:
                        low = np.partition(less[new], k + odds, axis=1)[:, k + odds]
                    kth[new] = np.where(np.isfinite(low) & (y - x > k + odds), low + slack, np.inf)
                i, j = np.divmod(np.flatnonzero(less <= (kth + slack)[:, None].astype(np.float32)), y - x)
                other = q[0][lo + i] != r[0][x + j]
                i, j = lo + i[other], x + j[other]
                if not len(i):
                    continue
                c = np.concatenate([dots(q[2][i[s : s + 65536]], r[2][j[s : s + 65536]]) for s in range(0, len(i), 65536)])
                n = q[3][i] * r[3][j]
                with np.errstate(all="ignore"):
                    c = np.where(n == 0, np.nan, c / n)
                rank = np.where(n == 0, np.inf, np.where(np.isnan(c), -np.inf, -np.round(c, 9)))
                some = np.unique(i)
                i = np.r_[np.repeat(some, k), i]
                rank, d, c = np.r_[near[some].ravel(), rank], np.r_[names[some].ravel(), r[0][j]], np.r_[value[some].ravel(), c]
                order = np.lexsort((d, rank, i))
                i, rank, d, c = i[order], rank[order], d[order], c[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                least = place < k
                i, place = i[least], place[least]
                near[i, place], names[i, place], value[i, place] = rank[least], d[least], c[least]

    def run(batches):
        def out():
            i, j = np.nonzero(names < far)
            none = np.isposinf(near[i, j])
            return pa.RecordBatch.from_arrays([pa.array(q[0][i]), pa.array(names[i, j]), pa.array(value[i, j], mask=none)], ["src", "dst", "cosine"])

        block, far = None, np.iinfo(np.int64).max
        for batch in batches:
            for r in range(batch.num_rows):
                if block != batch.column("q_b")[r].as_py():
                    if block is not None:
                        yield out()
                    block, q = batch.column("q_b")[r].as_py(), side(batch, r, "q")
                    shape = (len(q[0]), k)
                    near, names, value = np.full(shape, np.inf), np.full(shape, far), np.zeros(shape)
                look(q, side(batch, r, "r"), near, names, value)
        if block is not None:
            yield out()

    def own(df: DataFrame) -> DataFrame:
        v = as_vector(df, vector)
        whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
        none = F.array_repeat(F.lit(0.0), dim).cast("array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>")
        return df.where(F.col(group).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(group).alias("g"), F.when(whole, v).otherwise(none).alias("v"))

    near = block_pairs(own(queries), own(rows), "k", query_block, row_block).mapInArrow(run, "src long, dst long, cosine double")
    w = Window.partitionBy("src").orderBy(F.desc(F.round("cosine", 9)), "dst")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def as_vector(df: DataFrame, vector: str) -> Column:
    """Singles as they are, anything else as doubles."""
    return F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.transform(vector, lambda x: x.cast("double"))


def knn_edges(neighbours: DataFrame, rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Undirected edges src < dst without doubles; weight = max(0, dot product)."""
    e = neighbours.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    a, b = (rows.select(F.col(key).alias(x), F.col(vector).alias(f"_{x}")) for x in ("src", "dst"))
    return e.join(a, "src").join(b, "dst").select("src", "dst", F.greatest(F.lit(0.0), dot(F.col("_src"), F.col("_dst"))).alias("weight"))

"""From prepared rows, clusters and difficulties to a ranked curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators.batch import first_rows


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return df


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left that right doesn't have."""
    return left.select(key).join(right.select(key), key, "left_anti")


def strict_join(left: DataFrame, right: DataFrame, key: str, show: int = 10) -> DataFrame:
    """One-to-one inner join. Duplicate keys on the right or keys of left without a partner are errors that name some."""
    if twice := duplicate_keys(right, key).limit(show).collect():
        raise ValueError(f"duplicate {key}: {[r[key] for r in twice]}")
    if lost := missing_keys(left, right, key).limit(show).collect():
        raise KeyError(f"no match for {key}: {[r[key] for r in lost]}")
    return left.join(right, key)


def replace_infinite(df: DataFrame, column: str) -> DataFrame:
    """+inf becomes the greatest finite value plus 1 (0 if there is none)."""
    top = df.agg(F.coalesce(F.max(F.when(~F.isnan(column) & (F.abs(column) != float("inf")), F.col(column))) + 1.0, F.lit(0.0)).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.when(F.col(column) == float("inf"), F.col("_top")).otherwise(F.col(column))).drop("_top")  # one row


def rank_in_cluster(df: DataFrame, cluster: str, difficulty: str, tie: str) -> DataFrame:
    """0-based rank by difficulty within the cluster (ties by the given column) and the cluster's size."""
    w = Window.partitionBy(cluster)
    return df.withColumn("rank_in_cluster", F.row_number().over(w.orderBy(difficulty, tie)) - 1).withColumn("cluster_size", F.count(F.lit(1)).over(w))


def difficulty_stats(df: DataFrame, cluster: str, difficulty: str) -> DataFrame:
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(difficulty).alias("min_difficulty"),
        F.max(difficulty).alias("max_difficulty"),
        F.avg(difficulty).alias("mean_difficulty"),
        F.stddev_samp(difficulty).alias("std_difficulty"),
    )


def size_summary(df: DataFrame, cluster: str, noise: int | None = -1) -> DataFrame:
    """Of the clusters: how many, sizes min/max/mean/population std, ten largest, share of singletons and of noise rows."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")).withColumn("noise", F.col(cluster) == noise if noise is not None else F.lit(False))
    own = lambda c: F.when(~F.col("noise"), c)
    return sizes.agg(
        F.count(own(F.lit(1))).alias("num_clusters_found"),
        F.min(own(F.col("n"))).alias("cluster_size_min"),
        F.max(own(F.col("n"))).alias("cluster_size_max"),
        F.avg(own(F.col("n"))).alias("cluster_size_mean"),
        F.stddev_pop(own(F.col("n"))).alias("cluster_size_std"),
        F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(own(F.col("n"))), False), 1, 10), lambda x: x.cast("string")), ",").alias("top_10_cluster_sizes"),
        (F.count(own(F.when(F.col("n") == 1, 1))) / F.greatest(F.count(own(F.lit(1))), F.lit(1))).alias("singleton_ratio"),
        (F.coalesce(F.sum(F.when(F.col("noise"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("noise_ratio"),
    )


def join_manifest(df: DataFrame, key: str, cluster: str) -> DataFrame:
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("d"))
    return sizes.agg(
        F.sum("n").alias("n_rows"), F.sum("d").alias("n_ids"), F.count(F.lit(1)).alias("n_clusters"), F.min("n").alias("size_min"), F.max("n").alias("size_max"), F.avg("n").alias("size_mean")
    )


def finite_summary(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    finite = F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(finite).alias("n_finite"), F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("std"))


def top_k(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k of each group, with rank_in_selection from 1."""
    return df.withColumn("rank_in_selection", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank_in_selection") <= k)


def random_k(df: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """k of each group in the order of a seeded hash."""
    return top_k(df, group, [F.xxhash64(F.lit(seed), group, key), F.col(key)], k)


def fraction_subset(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """max(1, round-half-even(fraction * n)) rows, the first in the order of a seeded hash; caller restores the row order."""
    k = max(1, round(fraction * df.count()))
    return first_rows(df.withColumn("_h", F.xxhash64(F.lit(seed), key)), k, "_h", key).drop("_h")


def sample_rows(df: DataFrame, key: str, most: int, seed: int | None = None) -> DataFrame:
    """At most `most` rows (all, if it isn't positive): the first by key, or with a seed a sample without replacement."""
    if most <= 0:
        return df
    if seed is None:
        return first_rows(df, most, key)
    return first_rows(df.withColumn("_h", F.xxhash64(F.lit(seed), key)), most, "_h", key).drop("_h")


def cluster_meta(df: DataFrame, cluster: str, size: str, difficulty: str) -> DataFrame:
    """Per cluster: the size that its rows state (the least, should they differ) and the mean of the finite difficulties."""
    d = F.col(difficulty).cast("double")
    return df.groupBy(cluster).agg(F.min(size).alias("cluster_size"), F.avg(F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)).alias("mean_difficulty"))


def mean_nll(tokens: DataFrame, sample: str, nll: Column, is_answer: Column) -> DataFrame:
    """Mean negative log-likelihood over answer tokens; +inf for a sample without any."""
    own = F.when(is_answer, nll)
    return tokens.groupBy(sample).agg(F.coalesce(F.avg(own), F.lit(float("inf"))).alias("difficulty_score"), F.count(own).alias("n_tokens"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys; the rest of old stays."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def method_tag(method: Column, k: Column, resolution: Column | None = None) -> Column:
    """Short name of a clustering run: k64, sk64, bk64, gmm64, leiden_k30_r1p5."""
    short = F.when(method == "kmeans", F.concat(F.lit("k"), k.cast("string"))).when(method == "spherical_kmeans", F.concat(F.lit("sk"), k.cast("string")))
    short = short.when(method == "bisecting_kmeans", F.concat(F.lit("bk"), k.cast("string"))).when(method == "gmm", F.concat(F.lit("gmm"), k.cast("string")))
    if resolution is not None:
        short = short.when(method == "knn_leiden", F.concat(F.lit("leiden_k"), k.cast("string"), F.lit("_r"), F.replace(resolution.cast("string"), F.lit("."), F.lit("p"))))
    return short.otherwise(method)

"""Connected components of an edge table, on the executors only (alternating large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import cut_lineage


#: Rows of a partition of a light table.
LIGHT_ROWS = 250_000


def compact(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a light table, read back in partitions of LIGHT_ROWS or so: a few rows in as many partitions
    as the shuffle before had would make as many files in every shuffle after."""
    done = cut_lineage(df)
    return done.coalesce(max(1, -(-done.count() // LIGHT_ROWS)))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of u to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u (larger end of each edge) and its smaller neighbours to the least of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs to (node, root): root is the least node that node can reach; nodes without edges are absent.

    Nulls and loops are left out. The table never exceeds the number of edges; each step is a reliable checkpoint. Steps
    grow with the logarithm of the largest component; stars, the usual input here, need one.
    """
    now = compact(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = None
    while True:
        stars = now.agg(
            F.count(F.lit(1)),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)),
        ).first()
        if seen == tuple(stars) or stars[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
        seen = tuple(stars)
        now = compact(_small_star(_large_star(now)))

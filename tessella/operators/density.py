"""Hierarchical density clustering of vectors (HDBSCAN): mutual reachability, its minimum spanning tree, and the clusters
that persist longest as the density threshold falls.

The tree is grown by rounds that join every component but the largest with its nearest neighbour component. Edges come from
lists of nearest vectors; only vectors whose list ends before their component's best edge are compared with all others, in
blocks, as exact kNN does. Rounds grow with the logarithm of the number of vectors. What follows from the tree, whose edges
are one fewer than the vectors, is sequential and done in one task: MAX_VECTORS bounds it, and with it the components of
the tree while it grows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.vectors import as_vector, block_pairs, knn, measured, products
from tessella.session import cut_lineage

#: Vectors whose tree is condensed in one task; more is an error.
MAX_VECTORS = 5_000_000
#: Nearest vectors in the lists from which the tree is grown, as a multiple of min_samples.
LISTED = 2


def core_distances(df: DataFrame, key: str, vector: str, min_samples: int, dim: int) -> DataFrame:
    """(key, core): the distance to the min_samples-th nearest vector, the vector itself being the first."""
    if min_samples < 2:
        return df.select(key, F.lit(0.0).alias("core"))
    return _cores(knn(df, df, key, vector, min_samples - 1, dim), key, min_samples)


def _cores(near: DataFrame, key: str, min_samples: int) -> DataFrame:
    near = near.where(F.col("rank") < min_samples)
    return near.groupBy(F.col("src").alias(key)).agg(F.when(F.count(F.lit(1)) == min_samples - 1, F.max("distance")).otherwise(F.lit(float("inf"))).alias("core"))


def _nearest_outside(queries: DataFrame, rows: DataFrame, dim: int) -> DataFrame:
    """(c, w, src, dst): of each component c of queries (k, v, core, c, most) the least edge, at most `most` long, to a row
    (k, v, core, c) of another component; ties to the least (src, dst), src < dst."""

    def look(q, r, best):
        """Lower the best edges (w, src, dst) of the components of a block of queries by a block of rows, both in order of c."""
        pa_, pb, sa, slack = products(q["v"], r["v"])
        names, at = np.unique(q["c"], return_inverse=True)
        lows, highs = np.searchsorted(r["c"], names, "left"), np.searchsorted(r["c"], names, "right")
        if len(names) == 1 and highs[0] - lows[0] == len(r["c"]):
            return
        for lo in range(0, len(at), 256):
            part = slice(lo, lo + 256)
            own, d2 = at[part], pa_[part] @ pb
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for x, y in zip(cuts, cuts[1:]):
                d2[x:y, lows[own[x]] : highs[own[x]]] = np.inf
            if np.isinf(best["w"][own]).any():  # nothing is known yet: the nearest row is a bound
                i = np.flatnonzero(np.isinf(best["w"][own]))
                j = d2[i].argmin(1)
                i, j = i[np.isfinite(d2[i, j])], j[np.isfinite(d2[i, j])]
                w = np.maximum(np.maximum(measured(q["v"], r["v"], lo + i, j), q["core"][lo + i]), r["core"][j])
                np.minimum.at(best["w"], own[i], w)
            most = best["w"][own]
            near = (most + 2e-9) ** 2 + slack[part] - sa[part]
            i, j = np.divmod(np.flatnonzero((d2 <= near[:, None].astype(d2.dtype)) & np.isfinite(d2)), len(r["k"]))
            ok = (r["core"][j] <= most[i] + 1e-9) & (q["core"][lo + i] <= most[i] + 1e-9)
            i, j = lo + i[ok], j[ok]
            w = np.maximum(np.maximum(measured(q["v"], r["v"], i, j), q["core"][i]), r["core"][j])
            ok = np.isfinite(w)
            c, w, src, dst = at[i[ok]], w[ok], np.minimum(q["k"][i[ok]], r["k"][j[ok]]), np.maximum(q["k"][i[ok]], r["k"][j[ok]])
            order = np.lexsort((dst, src, w, c))
            first = order[np.unique(c[order], return_index=True)[1]]
            for x in first.tolist():  # one for each component of 256 queries, at most
                new, old = (w[x], src[x], dst[x]), (best["w"][c[x]], best["src"][c[x]], best["dst"][c[x]])
                if new < old:
                    best["w"][c[x]], best["src"][c[x]], best["dst"][c[x]] = new

    def run(batches):
        def out():
            ok = best["src"] < far
            return pa.RecordBatch.from_arrays([pa.array(names[ok]), *[pa.array(best[x][ok]) for x in ("w", "src", "dst")]], ["c", "w", "src", "dst"])

        block, far = None, np.iinfo(np.int64).max
        for batch in batches:
            for n in range(batch.num_rows):

                def side(name, fields, batch=batch, n=n):
                    got = {c: np.asarray(batch.column(f"{name}_{c}")[n].values, dtype=np.int64 if c in "kc" else float) for c in fields}
                    got["v"] = got["v"].reshape(-1, dim)
                    ok = np.flatnonzero(np.isfinite((got["v"] * got["v"]).sum(1)))
                    order = ok[np.argsort(got["c"][ok], kind="stable")]
                    return {c: x[order] for c, x in got.items()}

                if block != batch.column("q_b")[n].as_py():
                    if block is not None:
                        yield out()
                    block, q = batch.column("q_b")[n].as_py(), side("q", ("k", "v", "core", "c", "most"))
                    names, first = np.unique(q["c"], return_index=True)
                    best = {"w": q["most"][first], "src": np.full(len(names), far), "dst": np.full(len(names), far)}
                look(q, side("r", ("k", "v", "core", "c")), best)
        if block is not None:
            yield out()

    found = block_pairs(queries.select("k", "v", "core", "c", "most"), rows.select("k", "v", "core", "c"), "k", 8192, 8192)
    return found.mapInArrow(run, "c long, w double, src long, dst long")


def spanning_tree(rows: DataFrame, dim: int, near: DataFrame | None = None) -> DataFrame:
    """(src, dst, w) of the minimum spanning tree of rows (k, v, core); src < dst; ties by (w, src, dst).

    near (src, dst, distance, rank) holds lists of nearest vectors, as long for each vector, unless there are fewer others;
    without them, all vectors are compared in every round.
    """
    infinite, edge = F.lit(float("inf")), F.struct("w", "src", "dst").alias("m")
    rows = cut_lineage(rows.select(F.col("k").cast("long").alias("k"), as_vector(rows, "v").alias("v"), F.col("core").cast("double").alias("core")))
    labels = cut_lineage(rows.select("k", F.col("k").alias("c")))
    if near is None:
        ends, lists = rows.select("k", F.lit(-1.0).alias("end")), None
    else:
        # what a list leaves out is at least as far as its last one, to nine decimals
        longest = near.agg(F.max("rank")).first()[0] or 0
        ends = rows.join(near.groupBy(F.col("src").alias("k")).agg(F.max("distance").alias("_d"), F.count(F.lit(1)).alias("_n")), "k", "left")
        last = F.when(F.coalesce("_n", F.lit(0)) < longest, infinite).otherwise(F.coalesce("_d", F.lit(-1.0)) - 1e-9)
        ends = cut_lineage(ends.select("k", F.greatest(last, "core").alias("end") if longest else F.lit(-1.0).alias("end")))
        of = lambda side: rows.select(F.col("k").alias(side), F.col("core").alias(f"_{side}"))
        both = near.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("distance").alias("_w"))
        lists = both.join(of("src"), "src").join(of("dst"), "dst").select("src", "dst", F.greatest("_w", "_src", "_dst").alias("w")).where(F.col("w") < infinite)
    tree = None
    while True:
        sizes = labels.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c").limit(2).collect()
        if len(sizes) < 2:
            return tree if tree is not None else rows.select(F.col("k").alias("src"), F.col("k").alias("dst"), F.col("core").alias("w")).limit(0)
        best = None
        if lists is not None:
            at = lambda side: labels.select(F.col("k").alias(side), F.col("c").alias(f"c{side}"))  # noqa: E731, B023
            lists = cut_lineage(lists.select("src", "dst", "w").join(at("src"), "src").join(at("dst"), "dst").where("csrc <> cdst"))
            best = lists.select(F.explode(F.array("csrc", "cdst")).alias("c"), edge).groupBy("c").agg(F.min("m").alias("m"))
            best = cut_lineage(best)
        # the others' edges reach the largest component, so its own needn't be known
        small = labels.where(F.col("c") != sizes[0]["c"])
        known = small.join(best.select("c", F.col("m.w").alias("most")), "c", "left") if best is not None else small.withColumn("most", infinite)
        open_ = known.join(ends, "k").where(F.col("end") <= F.coalesce("most", infinite)).select("k", "c", F.coalesce("most", infinite).alias("most"))
        open_ = cut_lineage(open_)
        if not open_.isEmpty():
            found = _nearest_outside(open_.join(rows, "k"), rows.join(labels, "k"), dim).select("c", edge)
            best = cut_lineage((best.union(found) if best is not None else found).groupBy("c").agg(F.min("m").alias("m")))
        edges = cut_lineage(best.where(F.col("c") != sizes[0]["c"]).select("m.src", "m.dst", "m.w").dropDuplicates(["src", "dst"]))
        if edges.isEmpty():
            return tree if tree is not None else edges
        tree = edges if tree is None else cut_lineage(tree.union(edges))
        roots = tree.groupBy(F.lit(0).alias("_all")).applyInPandas(_roots, "node long, root long")
        labels = cut_lineage(labels.select("k").join(roots, F.col("k") == F.col("node"), "left").select("k", F.coalesce("root", "k").alias("c")))


def _roots(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, root) of the components of a forest of at most MAX_VECTORS - 1 edges."""
    names = np.unique(pdf[["src", "dst"]].to_numpy())
    parent = np.arange(len(names))
    for a, b in zip(np.searchsorted(names, pdf["src"]), np.searchsorted(names, pdf["dst"])):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        parent[max(a, b)] = min(a, b)
    while (parent != parent[parent]).any():
        parent = parent[parent]
    return pd.DataFrame({"node": names, "root": names[parent]})


def condense(edges: list[tuple[int, int, float]], n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: noise) and membership strengths of n points from the edges (a, b, w) of their spanning tree.

    Clusters of under `least` points fall out of their parent. Of the tree of the others, those are taken whose stability
    (the points' time in the cluster, by 1 / distance) exceeds that of the clusters in them; the root never is.
    """
    label, strength = np.full(n, -1), np.zeros(n)
    if n < 2:
        return label, strength
    # single linkage: a node of the merge tree for each edge, in order of distance
    parent = list(range(2 * n - 1))
    children, dist, size = {}, {}, [1] * n + [0] * (n - 1)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (a, b, w) in enumerate(sorted(edges, key=lambda e: (e[2], e[0], e[1]))):
        x, y, new = find(a), find(b), n + i
        children[new], dist[new], size[new] = (x, y), w, size[x] + size[y]
        parent[x] = parent[y] = new
    top = n + len(edges) - 1

    low = list(range(n)) + [0] * len(children)  # least point of each node
    for node, (x, y) in children.items():
        low[node] = min(low[x], low[y])

    def points(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += children[x]
        return out

    born, inside, sub = {top: 0.0}, {top: []}, {}  # of each cluster: birth, (node, time its points fell out), clusters in it
    todo = [(top, top)]
    while todo:
        node, cluster = todo.pop()
        if node < n:
            inside[cluster].append((node, np.inf))
            continue
        now = 1 / dist[node] if dist[node] > 0 else np.inf
        x, y = children[node]
        if size[x] >= least and size[y] >= least:
            sub[cluster] = (x, y)
            for c in (x, y):
                born[c], inside[c] = now, []
                todo.append((c, c))
            inside[cluster] += [(x, now), (y, now)]
            continue
        for c in (x, y):
            if size[c] >= least:
                todo.append((c, cluster))
            else:
                inside[cluster].append((c, now))
    finite = [t for rows in inside.values() for _, t in rows if np.isfinite(t)]
    most = max(finite, default=1.0)
    stability = {c: sum(size[x] * (min(t, most) - min(born[c], most)) for x, t in rows) for c, rows in inside.items()}
    chosen, total = set(), dict(stability)
    for c in sorted(inside):  # a cluster's own number is above those of the clusters in it
        if c in sub:
            below = total[sub[c][0]] + total[sub[c][1]]
            if c == top or below > stability[c]:
                total[c] = below
                continue
        if c != top:
            chosen.add(c)
    taken, todo = [], [top]
    while todo:  # those in a chosen cluster aren't taken
        c = todo.pop()
        if c in chosen:
            taken.append(c)
        else:
            todo += sub.get(c, ())
    for k, c in enumerate(sorted(taken, key=lambda c: low[c])):
        rows = [(p, min(t, most)) for x, t in inside[c] for p in points(x)]
        high = max(t for _, t in rows)
        for p, t in rows:
            label[p], strength[p] = k, t / high if high > 0 else 1.0
    return label, strength


def hdbscan(df: DataFrame, key: str, vector: str, dim: int, min_cluster_size: int = 30, min_samples: int | None = None) -> DataFrame:
    """(key, cluster_id, cluster_confidence): -1 is noise, with confidence 0; clusters are numbered by their least place in key order."""
    n = df.count()
    if n > MAX_VECTORS:
        raise ValueError(f"more than {MAX_VECTORS} vectors")
    min_samples = min_samples or min_cluster_size
    near = cut_lineage(knn(df, df, key, vector, LISTED * min_samples, dim))
    core = _cores(near, "k", min_samples) if min_samples > 1 else df.select(F.col(key).alias("k"), F.lit(0.0).alias("core"))
    rows = df.select(F.col(key).alias("k"), as_vector(df, vector).alias("v")).join(core, "k", "left")
    tree = spanning_tree(rows.withColumn("core", F.coalesce("core", F.lit(float("inf")))), dim, near)
    all_ = df.select(F.col(key).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("w")).union(tree)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.loc[pdf["dst"].isna(), "src"].to_numpy())
        e = pdf[pdf["dst"].notna()]
        at = lambda c: np.searchsorted(ids, e[c].to_numpy(dtype=np.int64)).tolist()
        label, strength = condense(list(zip(at("src"), at("dst"), e["w"].tolist())), len(ids), min_cluster_size)
        return pd.DataFrame({key: ids, "cluster_id": label, "cluster_confidence": strength})

    return all_.groupBy(F.lit(0).alias("_all")).applyInPandas(run, f"{key} long, cluster_id int, cluster_confidence double")

"""Near-duplicate documents by BagMinHash over the multiset of five-word shingles.

Signatures: a shingle of weight w owns the weight levels 1..w. Levels lie in dyadic nodes (0,1], (1,2], (2,4], (4,8]..;
each (shingle, node) has a Poisson process whose rate is the node's width and whose points fall to one of M components
and to one level of the node, both at random; a point counts if its level is at most w. A component's value is the
least time of its points. Two documents agree in a component with the probability of their weighted Jaccard likeness.
Points come in order of time, so a process ends once it is later than all components of its document.

Candidates: BANDS bands of ROWS components. Equal texts are one node from the start. Within a bucket every node is first
compared with the least one only; then, in buckets that still hold several classes, the members of different ones are
compared in blocks. A large class has blocks of its own, so its members are never paired with each other; and signatures
alone decide which nodes of a block have a partner in it, before any text is sent there. Every link is verified by the
exact multiset overlap. Components of the links are the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.blocks import BLOCK, runs
from tessella.llm.bloom import membership
from tessella.llm.components import compact, components
from tessella.llm.words import U, Words, frugal, mix, slices, windows
from tessella.session import cut_lineage

SHINGLE = 5
BANDS, ROWS = 26, 5
M = BANDS * ROWS
#: Bands whose buckets are compared across classes together; what one round joins, the next needn't compare.
ROUNDS = ((0, 2), (2, BANDS))
#: Followers that a lead's text is sent to at a time.
LEAD_BLOCK = 256
#: Stands for the classes of a bucket that are too small for blocks of their own.
SMALL = -1
BLOCK_KEY = ["band", "hash", "ga", "i", "gb", "j"]

_HIGH = U(48)
_LOW = U((1 << 48) - 1)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a slice: row, hash and weight, sorted by row. A row of fewer words has one shingle of all."""
    h = words.hashes()
    at = np.flatnonzero(words.left() >= SHINGLE)
    row, value = words.row[at], windows(h, SHINGLE)[at]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        own = np.array([int.from_bytes(hashlib.blake2b(h[words.first[r] : words.first[r + 1]].tobytes(), digest_size=8).digest(), "little") for r in short], dtype=U)
        row, value = np.r_[row, short], np.r_[value, own]
    key = np.sort((row.astype(U) << _HIGH) | (value >> U(16)))
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    weight = np.diff(np.r_[at, len(key)])
    return (key[at] >> _HIGH).astype(np.int64), mix(key[at] & _LOW), weight


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from the high bits."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def bag_minhash(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, m: int = M) -> np.ndarray:
    """Signatures n_rows x m of multisets given as (row, element, weight), sorted by row; rows without elements are inf."""
    best = np.full((n_rows, m), np.inf)
    flat = best.ravel()
    lo, width = np.zeros(len(row), np.int64), np.ones(len(row), np.int64)
    parts = [(row, element, weight, lo, width)]
    low = 1
    while len(row) and weight.max() > low:  # the nodes (low, 2 low] of the heavier elements
        sel = weight > low
        row, element, weight = row[sel], element[sel], weight[sel]
        parts.append((row, element, weight, np.full(len(row), low), np.full(len(row), low)))
        low *= 2
    row, element, weight, lo, width = (np.concatenate(x) for x in zip(*parts))
    if len(parts) > 1:
        order = np.argsort(row, kind="stable")
        row, element, weight, lo, width = row[order], element[order], weight[order], lo[order], width[order]
    state = mix(element ^ mix(lo.astype(U) + U(77)))
    time = np.zeros(len(row))
    while len(row):
        state = mix(state + U(0x9E3779B97F4A7C15))
        time = time - np.log(_unit(state)) / width
        pick = mix(state ^ U(0x5851F42D4C957F2D))
        place = (pick >> U(40)).astype(np.int64) * m >> 24
        level = lo + ((pick & U(0xFFFFFFFF)).astype(np.int64) * width >> 32)
        ok = level < weight
        np.minimum.at(flat, row[ok] * m + place[ok], time[ok])
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        latest = np.repeat(best[row[at]].max(axis=1), np.diff(np.r_[at, len(row)]))
        go = time < latest
        row, weight, lo, width, state, time = row[go], weight[go], lo[go], width[go], state[go], time[go]
    return best


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document, 128 bits that stand for the text, and the hashes of its bands (none without words)."""
    for batch in batches:
        texts = batch.column("text")
        for words in slices(texts):
            row, element, weight = shingles(words)
            sig = bag_minhash(row, element, weight, words.rows).view(U).reshape(words.rows, BANDS, ROWS)
            band = np.zeros((words.rows, BANDS), dtype=U)
            for k in range(ROWS):
                band = mix(band ^ sig[:, :, k]) + U(k)
            filled = np.where(words.count > 0, BANDS, 0)
            ends = np.r_[0, np.cumsum(filled)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(band[words.count > 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc").slice(words.lo, words.rows), batch.column("key").slice(words.lo, words.rows), lists], ["doc", "key", "bands"])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard likeness of two multisets given as (sorted elements, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - both
    return both / whole if whole else 0.0


def _bags(texts: pa.Array) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Of each row, its place and its multiset, elements sorted."""
    for words in slices(texts):
        row, element, weight = shingles(words)
        cut = np.searchsorted(row, np.arange(words.rows + 1))
        for r in range(words.rows):
            e, w = element[cut[r] : cut[r + 1]], weight[cut[r] : cut[r + 1]]
            order = np.argsort(e)
            yield words.lo + r, (e[order], w[order])


def _led(threshold: float):
    """Links to leads. Rows come by lead and part, each part's first row being the lead itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, lead = None, None
        for batch in batches:
            u, v = np.asarray(batch.column("u")), np.asarray(batch.column("v"))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, bag in _bags(batch.column("text")):
                if u[k] == v[k]:
                    of, lead = v[k], bag
                elif of == v[k]:
                    keep[k] = overlap(bag, lead) >= threshold
                else:
                    raise ValueError(f"the text of node {v[k]} is missing")
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    return run


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each block that have a node of another class there with which they first agree in the block's band."""
    for group in runs(batches, BLOCK_KEY):
        n, root, band = group.num_rows, np.asarray(group.column("root")), group.column("band")[0].as_py()
        part = np.asarray(group.column("part"))
        bands = np.asarray(group.column("bands").combine_chunks().flatten()).reshape(n, BANDS)
        apart = part.min() != part.max()
        has = np.zeros(n, dtype=bool)
        for lo in range(0, n, 128):
            hi = min(n, lo + 128)
            fit = (root[lo:hi, None] != root) & (bands[lo:hi, None, band] == bands[None, :, band])
            if apart:
                fit &= part[lo:hi, None] != part
            for k in range(band):
                fit &= bands[lo:hi, None, k] != bands[None, :, k]
            has[lo:hi] = fit.any(1)
        if has.any():
            yield group.select([*BLOCK_KEY, "part", "node", "root"]).filter(pa.array(has)).combine_chunks().to_batches()[0]


def _overlaps(code: np.ndarray, start: np.ndarray, by_code: np.ndarray, code_start: np.ndarray, x: int, n: int) -> np.ndarray:
    """How many elements row x shares with each of n rows. code lists the rows' elements, by_code the elements' rows."""
    out = np.zeros(n, dtype=np.int64)
    own = code[start[x] : start[x + 1]]
    size = code_start[own + 1] - code_start[own]
    ends = np.cumsum(size)
    lo = 0
    while lo < len(own):  # a few million rows at a time
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + 4_000_000, side="right")))
        part = size[lo:hi]
        at = np.repeat(code_start[own[lo:hi]] - (ends[lo:hi] - part - base), part) + np.arange(int(part.sum()))
        out += np.bincount(by_code[at], minlength=n)
        lo = hi
    return out


def _across(threshold: float):
    """Verified links between different classes in a block, each pair in the first band that it shares.

    An element of weight w counts as w elements, so the overlap of two multisets is a count of shared elements, and one
    pass over a row's elements gives its overlap with all rows of the block. Only links that join what wasn't joined in
    the block before are written: at most one fewer than its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, BLOCK_KEY):
            n, ids, root = group.num_rows, np.asarray(group.column("node")), np.asarray(group.column("root"))
            band, part = group.column("band")[0].as_py(), np.asarray(group.column("part"))
            apart = part.min() != part.max()
            bands = np.asarray(group.column("bands").combine_chunks().flatten()).reshape(n, BANDS)
            rows, elements = [], []
            for words in slices(group.column("text").combine_chunks()):
                r, e, w = shingles(words)
                copy = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                rows.append(words.lo + np.repeat(r, w))
                elements.append(mix(np.repeat(e, w) + copy.astype(U)))
            row = np.concatenate(rows)
            names, code = np.unique(np.concatenate(elements), return_inverse=True)
            size = np.bincount(row, minlength=n)
            start = np.r_[0, np.cumsum(size)]
            by_code = row[np.argsort(code, kind="stable")]
            code_start = np.r_[0, np.cumsum(np.bincount(code, minlength=len(names)))]
            label = np.unique(root, return_inverse=True)[1]
            links: list[tuple[int, int]] = []
            for x in range(n):
                other = np.flatnonzero((label[x + 1 :] != label[x]) & ((part[x + 1 :] != part[x]) if apart else True)) + x + 1
                if not len(other):
                    continue
                same = bands[other] == bands[x]
                other = other[same[:, band] & (same.argmax(1) == band)]
                if not len(other):
                    continue
                both = _overlaps(code, start, by_code, code_start, x, n)[other]
                for y in other[both >= threshold * (size[x] + size[other] - both)]:
                    if label[y] != label[x]:
                        label[label == label[y]] = label[x]
                        links.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
            if links:
                u, v = np.array(links, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _parts(size: str, of: str, block: int = BLOCK) -> Column:
    """Which of the parts of about `block` rows a row is in; a group of up to 2 * block rows is one part."""
    k = F.when(F.col(size) <= 2 * block, F.lit(1)).otherwise(F.ceil(F.col(size) / block)).cast("int")
    return F.pmod(F.xxhash64(F.lit("part"), F.col(of)), k).cast("int")


def _in_class_blocks(rows: DataFrame) -> DataFrame:
    """Rows (band, hash, node, root, ..) of open buckets, once for each block that they are in, blocks together.

    A class of over BLOCK rows of a bucket is a group, cut into parts by node; the others together are the group SMALL,
    cut by root. A block is a pair of parts of different groups, or of SMALL with itself. `part` tells a block's sides
    apart: 0 and 1, or 0 throughout for a part with itself.
    """
    bucket = ["band", "hash"]
    sizes = rows.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.when(F.col("n") > BLOCK, F.col("root")).otherwise(F.lit(SMALL).cast("long")))
    totals = sizes.groupBy(*bucket, "g").agg(F.sum("n").alias("load"))
    sizes = compact(sizes.select(*bucket, "root", "g").join(totals, [*bucket, "g"]))
    own = rows.join(sizes, [*bucket, "root"]).withColumn("c", F.when(F.col("g") == SMALL, _parts("load", "root")).otherwise(_parts("load", "node"))).drop("load")
    # in SMALL a root with all its rows is in one part, which may thus be somewhat larger than BLOCK
    group = sizes.groupBy(*bucket, "g").agg(F.max("load").alias("load")).withColumn("k", F.when(F.col("load") <= 2 * BLOCK, F.lit(1)).otherwise(F.ceil(F.col("load") / BLOCK)).cast("int"))
    part_of = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    a, b = (group.select(*bucket, F.col("g").alias(f"g{x}"), F.col("k").alias(f"k{x}")) for x in "ab")
    between = a.join(b, bucket).where("ga < gb").withColumn("i", part_of("ka")).withColumn("j", part_of("kb")).select(*BLOCK_KEY)
    small = group.where(F.col("g") == SMALL).select(*bucket, "k", F.col("g").alias("ga"), F.col("g").alias("gb")).withColumn("i", part_of("k"))
    within = small.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("k") - 1)))
    blocks = compact(between.union(within.select(*BLOCK_KEY)))
    first = own.join(blocks.withColumnRenamed("ga", "g").withColumnRenamed("i", "c"), [*bucket, "g", "c"])
    first = first.withColumnRenamed("g", "ga").withColumnRenamed("c", "i").withColumn("part", F.lit(0))
    other = blocks.where("ga <> gb or i <> j").withColumnRenamed("gb", "g").withColumnRenamed("j", "c")
    second = own.join(other, [*bucket, "g", "c"]).withColumnRenamed("g", "gb").withColumnRenamed("c", "j").withColumn("part", F.lit(1))
    return first.unionByName(second)


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Of all rows with an id and a text: doc, key (MD5 of the text), class_id, n_equal and kept; and the other rows' ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    light = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    known = light.where("doc is not null and text is not null").withColumn("key", F.md5("text"))
    sketches = cut_lineage(known.mapInArrow(frugal(_sketch), f"doc {kind}, key string, bands array<long>"))
    texts = sketches.groupBy("key").agg(F.first("bands").alias("bands"), F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n_equal"))
    nodes = cut_lineage(texts.withColumn("node", F.monotonically_increasing_id()))  # fixed from here on: the checkpoint is read, not made again
    posted = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = posted.groupBy("band", "hash").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("load")).where("load > 1")
    shared = cut_lineage(posted.join(buckets, ["band", "hash"]).select("band", "hash", "node", "lead"))  # nodes that share a bucket with another
    # only texts that may be in a pair are shuffled, one of each node; the joins decide
    wanted = shared.select("node").distinct().join(nodes, "node").select("node", "key", "doc", F.xxhash64("doc", "key").alias("of"))
    maybe = membership(wanted, "of")(F.xxhash64("doc", "key"))
    whole = known.where(maybe).join(wanted.select("key", "node", F.col("doc").alias("least")), "key").where("doc = least")
    whole = cut_lineage(whole.select("node", "text"))

    pairs = shared.where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct()
    led_by = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("load"))
    pairs = compact(pairs.join(led_by, "v").withColumn("part", _parts("load", "u", LEAD_BLOCK)).select("u", "v", "part"))
    leads = pairs.select(F.col("v").alias("u"), "v", "part").distinct()  # a lead goes to each part of its followers once
    by_lead = pairs.union(leads).join(whole.withColumnRenamed("node", "u"), "u").repartition("v", "part").sortWithinPartitions("v", "part", F.col("u") != F.col("v"))
    led = compact(by_lead.select("u", "v", "text").mapInArrow(frugal(_led(threshold)), "u long, v long"))

    links, roots = led, compact(components(led))
    for lo, hi in ROUNDS:
        own = shared.where(F.col("band").between(lo, hi - 1))
        rooted = own.join(roots, "node", "left").select("band", "hash", "node", F.coalesce("root", "node").alias("root"))
        mixed = rooted.groupBy("band", "hash").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("band", "hash")
        open_ = compact(rooted.join(mixed, ["band", "hash"], "left_semi"))
        signed = _together(_in_class_blocks(open_).join(nodes.select("node", "bands"), "node").select(*BLOCK_KEY, "part", "node", "root", "bands"))
        paired = compact(signed.mapInArrow(frugal(_paired), "band int, hash long, ga long, i int, gb long, j int, part int, node long, root long"))
        if paired.isEmpty():
            continue
        needed = whole.where(membership(paired.select("node").distinct(), "node")(F.col("node")))  # again: only these are shuffled
        read = _together(paired.join(nodes.select("node", "bands"), "node").join(needed, "node").select(*BLOCK_KEY, "part", "node", "root", "bands", "text"))
        across = compact(read.mapInArrow(frugal(_across(threshold)), "u long, v long").distinct())
        links = links.union(across)
        roots = compact(components(links))
    least = roots.join(nodes.select("node", "doc", "key"), "node").groupBy("root").agg(F.min(F.struct("doc", "key")).alias("least"))
    classed = roots.join(least, "root").select("node", "least")
    of_text = nodes.join(classed, "node", "left").select("key", F.coalesce("least", F.struct("doc", "key")).alias("least"), "n_equal")
    placed = sketches.select("doc", "key").join(of_text, "key").select("doc", "key", F.col("least.doc").alias("class_id"), "n_equal", (F.struct("doc", "key") == F.col("least")).alias("kept"))
    return placed, light.where("doc is null or text is null").select("doc")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least doc_id of its class), n_equal (documents of equal text), kept.

    Two different texts are linked if the multisets of their five-word shingles overlap by threshold or more (texts of
    fewer words have one shingle: all their words) and they share a band, as at 0.8 all but 3 in 100,000 pairs do. A null text links with nothing and is kept; texts without words
    link only with equal texts. A null doc_id is its own class (class_id null) and kept. Ids may be of any ordered type.
    Rows are classed by their text, so rows of equal doc_id and different text may be in different classes; of a class,
    the rows equal to its least (doc_id, MD5 of the text) are kept. Texts are compared whole, however long they are.
    Other columns are not read. An empty table gives no rows.
    """
    placed, alone = _classes(docs, threshold, id_col, text_col)
    alone = alone.select("doc", F.lit(None).cast("string"), F.col("doc").alias("class_id"), F.lit(1).cast("long").alias("n_equal"), F.lit(True))
    return placed.union(alone).select(F.col("doc").alias("doc_id"), "class_id", "n_equal", "kept")


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each class kept: the one of least doc_id (see near_duplicates for nulls and repeats)."""
    placed, _ = _classes(docs, threshold, id_col, text_col)
    gone = compact(placed.where("not kept").select(F.xxhash64("doc", "key").alias("_of"), F.col("doc").alias("_gone"), F.col("key").alias("_key")))
    maybe = membership(gone, "_of")(F.xxhash64(F.col(id_col), F.md5(text_col)))  # the rest stays where it is
    doubtful = docs.where(maybe)
    same = (doubtful[id_col] == gone["_gone"]) & (F.md5(doubtful[text_col]) == gone["_key"])
    return docs.where(~maybe).union(doubtful.join(gone, same, "left_anti"))

"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source form a stream: its documents in a keyed hash order, cut into blocks of BLOCK_WORDS words. The mix
takes every block of whole passes and, of one more pass, as many as the target needs. Which these are, and in what
order, follows from a keyed permutation of the block numbers in each pass, so blocks are drawn without replacement. A
tree over the output shards splits the vector of the sources' block quotas in two, again and again, by
multivariate-hypergeometric draws: every shard gets an exact number of blocks of every source, and it draws these from
the permuted order where the shards before it ended. Documents are cut where their blocks end. Within a shard, a keyed
hash gives the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tessella.llm.components import compact
from tessella.llm.words import U, frugal, mix, slices
from tessella.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block. A source's last block is shorter; it is the last that a pass draws.
BLOCK_WORDS = 2048
#: Streams are summed up in so many buckets of a source before they are ordered within.
STREAM_BUCKETS = 1 << 16
#: Totals of so many sources may come to the driver; more is an error, not a cut.
MAX_SOURCES = 100_000
ROUNDS = 6


def targets(sizes: list[int], weights: list[float], ratio: float, cap: float) -> list[float]:
    """Words to take from each source: ratio times all words by weight, no source above cap times its own.

    What a capped source can't take is shared among the others by weight, until none is above its cap.
    """
    out, left, open_ = [0.0] * len(sizes), ratio * sum(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` draws without replacement are good. Populations may be of any size.

    The probabilities come from their ratios, over all values but those beyond 14 standard deviations.
    """
    low, high, n = max(0, draws - bad), min(draws, good), good + bad
    if low == high:
        return low
    mean = draws * good / n
    sd = (mean * (bad / n) * ((n - draws) / max(1, n - 1))) ** 0.5
    lo, hi = max(low, int(mean - 14 * sd) - 14), min(high, int(mean + 14 * sd) + 14)
    k = np.arange(lo, hi, dtype=np.float64)
    logs = np.r_[0.0, np.cumsum(np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1))]
    sums = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def split_quotas(blocks: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard: an array sources x shards whose rows sum to blocks; shards near equal."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(blocks), n_shards), dtype=np.int64)

    def split(quota: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[:, first] = quota
            return
        middle, total = (first + last) // 2, int(quota.sum())
        take = total * (middle - first) // (last - first)
        left, rest = np.zeros_like(quota), total
        for i, own in enumerate(quota.tolist()):  # the marginal of each source, given those before it
            rest -= own
            left[i] = hypergeometric(rng, own, rest, take)
            take -= int(left[i])
        split(left, first, middle)
        split(quota - left, middle, last)

    if len(blocks):
        split(np.asarray(blocks, dtype=np.int64), 0, n_shards)
    return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of each x in 0..n-1 its place in a permutation of 0..n-1 that key selects: a Feistel network with cycle walking."""
    a = np.maximum(np.ceil(np.sqrt(n.astype(np.float64))).astype(np.int64), 1)
    b = np.maximum(-(-n // a), 1)
    out, walking = x.astype(np.int64), np.ones(len(x), dtype=bool)
    while walking.any():
        left, right = np.divmod(out[walking], b[walking])
        for r in range(ROUNDS):
            turn, other, width = (left, right, a[walking]) if r % 2 == 0 else (right, left, b[walking])
            noise = mix(mix(key[walking] + U(r)) ^ other.astype(U)) >> U(1)
            turn = (turn + (noise.astype(np.int64) % width)) % width
            left, right = (turn, right) if r % 2 == 0 else (left, turn)
        out[walking] = left * b[walking] + right
        walking &= out >= n
    return out


class Plan:
    """What the mix draws of each source, known by its number."""

    def __init__(self, sizes: list[int], goals: list[float], n_shards: int, seed: int):
        self.seed = seed
        self.size = np.array(sizes, dtype=np.int64)
        self.goal = np.array([round(g) for g in goals], dtype=np.int64)
        self.passes, rest = np.divmod(self.goal, np.maximum(self.size, 1))
        self.full = self.size // BLOCK_WORDS
        self.blocks = -(-self.size // BLOCK_WORDS)
        self.drawn = -(-rest // BLOCK_WORDS)  # of the pass that isn't whole
        self.end = rest - (self.drawn - 1) * BLOCK_WORDS  # words of the last block drawn
        self.bounds = np.cumsum(split_quotas(self.passes * self.blocks + self.drawn, n_shards, seed), axis=1)

    def draws(self, no: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray) -> dict[str, np.ndarray]:
        """What is taken of rows of source `no` that hold the words start..start+size-1 of its stream; of: a hash of each.

        Pieces come by row, copy and first word: row, copy, start (first word of the piece in its row), words, shard
        and position (its place in the shard's order, a hash).
        """
        times = np.where(size > 0, self.passes[no] + (self.drawn[no] > 0), 0)
        row = np.repeat(np.arange(len(no)), times)
        copy = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        low = start[row] // BLOCK_WORDS
        count = (start[row] + size[row] - 1) // BLOCK_WORDS - low + 1
        block = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        row, copy = np.repeat(row, count), np.repeat(copy, count)
        s = no[row]
        key = mix((s.astype(U) << U(20)) + copy.astype(U) + mix(np.full(len(s), self.seed % (1 << 63), dtype=U)))
        rank = self.full[s].copy()  # the short block
        inner = block < self.full[s]
        rank[inner] = permuted(block[inner], self.full[s][inner], key[inner])
        whole = copy < self.passes[s]
        stop = np.where(~whole & (rank == self.drawn[s] - 1), block * BLOCK_WORDS + self.end[s], (block + 1) * BLOCK_WORDS)
        first = np.maximum(start[row], block * BLOCK_WORDS)
        words = np.minimum(start[row] + size[row], stop) - first
        keep = (whole | (rank < self.drawn[s])) & (words > 0)
        row, copy, block, s, rank, first, words = (x[keep] for x in (row, copy, block, s, rank, first, words))
        shard = np.zeros(len(row), dtype=np.int32)
        place = copy * self.blocks[s] + rank
        for x in np.unique(s):
            own = s == x
            shard[own] = np.searchsorted(self.bounds[x], place[own], side="right")
        position = mix(mix(of[row].view(U)) + mix((block.astype(U) << U(8)) + copy.astype(U))).view(np.int64)
        return {"row": row, "copy": copy.astype(np.int32), "start": first - start[row], "words": words, "shard": shard, "position": position}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _planned(docs: DataFrame, keep: bool, weights: tuple[float, ...], ratio: float, cap: float, n_shards: int, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, Plan]:
    """Rows _id, _source, _size, _of, _no, _start, _total, _target (and _row: all of docs' columns, if kept), and the plan."""
    of = F.xxhash64(F.lit("mix"), F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("_key"),  # never null: one shuffle by it serves all
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        of.alias("_of"),
        F.shiftrightunsigned(of, 48).cast("int").alias("_bucket"),
        *([F.struct(*[docs[_quoted(c)] for c in docs.columns]).alias("_row")] if keep else []),
    )
    light = cut_lineage(rows.drop("_row"))
    sums = light.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_words"))
    totals = sums.groupBy("_key").agg(F.sum("_words").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["_key"] == "", r["_key"].encode()))
    sizes = [int(r["words"]) for r in totals]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], ratio, cap)
    known = docs.sparkSession.createDataFrame(
        [(r["_key"], i, s, float(g)) for i, (r, s, g) in enumerate(zip(totals, sizes, goals))], "_key string, _no int, _total long, _target double"
    )
    by_bucket = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = compact(sums.select("_key", "_bucket", F.coalesce(F.sum("_words").over(by_bucket), F.lit(0)).alias("_offset")))
    within = Window.partitionBy("_key", "_bucket").orderBy("_of", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        (rows if keep else light)
        .withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0)))
        .join(offsets, ["_key", "_bucket"])
        .join(F.broadcast(known), "_key")  # at most MAX_SOURCES rows
        .withColumn("_start", F.col("_offset") + F.col("_within"))
    )
    columns = ["_id", "_source", "_size", "_of", "_no", "_start", "_total", "_target", *(["_row"] if keep else [])]
    return placed.select(*columns), Plan(sizes, goals, n_shards, seed)


def _of_batch(plan: Plan, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return plan.draws(*(np.asarray(batch.column(c)).astype(np.int64) for c in ("_no", "_start", "_size", "_of")))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    ratio: float = 1.5,
    cap: float = 2.0,
    n_shards: int = 16,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Plan a mix: one row per document with what the mix takes of it.

    Sources, sorted by code point with null last, weigh `weights`, repeating. Returns doc_id, source, size (words),
    source_size, target (of the source), taken (words, repeats counted) and draws: array of struct(copy, start, words,
    shard, position), one for each piece taken, in order: `words` words from word `start` on. A document within one
    block is one piece. A source's pieces sum to its target, rounded. A null text has no words and is never taken. A
    null doc_id takes part like any other; rows equal in doc_id and text may swap places. Very long texts are cut at
    block ends like others. Other columns aren't read. An empty table gives no rows. Reruns agree.
    """
    rows, plan = _planned(docs, False, weights, ratio, cap, n_shards, seed, id_col, text_col, source_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _of_batch(plan, batch)
            n = batch.num_rows
            taken = np.zeros(n, dtype=np.int64)
            np.add.at(taken, d["row"], d["words"])
            ends = np.r_[0, np.cumsum(np.bincount(d["row"], minlength=n))].astype(np.int32)
            names = ["copy", "start", "words", "shard", "position"]
            pieces = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(d[x]) for x in names], names))
            columns = [batch.column(c) for c in ("_id", "_source", "_size", "_total", "_target")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(taken), pieces], ["doc_id", "source", "size", "source_size", "target", "taken", "draws"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, source string, size long, source_size long, target double, taken long, draws array<struct<copy: int, start: long, words: long, shard: int, position: long>>"
    )


def _cut(texts: pa.Array, d: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The pieces' numbers and texts, a slice of rows at a time. A row's pieces, joined, are its text."""
    for words in slices(texts):
        lo, hi = np.searchsorted(d["row"], [words.lo, words.lo + words.rows])
        if lo == hi:
            continue
        row, start, count = d["row"][lo:hi] - words.lo, d["start"][lo:hi], d["words"][lo:hi]
        begins = np.r_[0, words.byte_ends[:-1]]
        at = words.first[row] + start
        a = np.where(start == 0, begins[row], words.end[np.maximum(at - 1, 0)])
        b = np.where(start + count == words.count[row], words.byte_ends[row], words.end[at + count - 1])
        data = words.data.tobytes()
        yield np.arange(lo, hi), [data[x:y].decode() for x, y in zip(a.tolist(), b.tolist())]


def mixed_documents(docs: DataFrame, shard_col: str | None = None, **options) -> DataFrame:
    """The mix itself: the documents' columns, a row for each piece that the mix takes (see mix_sources).

    The rows of a shard lie together, by shard number and then in the shard's shuffled order; with shard_col its number
    is a column more. A piece is its part of the text, white space included: the pieces of one copy, joined, are the
    text. n_chars, where there is such a column, follows the text. Rows without words are never taken. Repeated ids and
    rows are no special case: each row is drawn by itself. Columns may have any names.
    """
    defaults = {"weights": (3.0, 1.0, 2.0), "ratio": 1.5, "cap": 2.0, "n_shards": 16, "seed": 0, "id_col": "doc_id", "text_col": "text", "source_col": "source"}
    o = defaults | options
    rows, plan = _planned(docs, True, **o)
    text_no = docs.columns.index(o["text_col"])
    chars_no = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, parts = _of_batch(plan, batch), batch.column("_row").flatten()
            for at, texts in _cut(parts[text_no], d):
                columns = [c.take(pa.array(d["row"][at])) if k != text_no else pa.array(texts, c.type) for k, c in enumerate(parts)]
                if chars_no is not None:
                    columns[chars_no] = pa.array([len(t) for t in texts]).cast(columns[chars_no].type)
                struct = pa.StructArray.from_arrays(columns, docs_names)
                yield pa.RecordBatch.from_arrays([struct, pa.array(d["shard"][at]), pa.array(d["position"][at])], ["_row", "_shard", "_position"])

    docs_names = list(docs.columns)
    schema = StructType([rows.schema["_row"], StructField("_shard", IntegerType()), StructField("_position", LongType())])
    pieces = rows.select("_no", "_start", "_size", "_of", "_row").mapInArrow(frugal(run), schema)
    # a shard goes to as many partitions as it takes to use them all, cut by position, which is random
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // o["n_shards"])
    pieces = pieces.withColumn("_part", F.pmod("_position", F.lit(width))).repartition(o["n_shards"] * width, "_shard", "_part").sortWithinPartitions("_shard", "_part", "_position")
    return pieces.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], *([F.col("_shard").alias(shard_col)] if shard_col else []))

"""Removal of passages that an earlier document has, found through difference-cover anchors.

D is a difference cover modulo PERIOD: any two numbers differ, modulo PERIOD, as two members of D do. Hash the windows
of LENGTH - PERIOD + 1 words that begin at places p with p mod PERIOD in D. If two documents share LENGTH words, at
places i and j, there is a shift s < PERIOD with i + s and j + s both at cover places, so both have hashed the same
anchor. Anchors are sampled at |D| / PERIOD of all places. What two documents' anchors share is only a candidate: it is
extended to all windows of LENGTH words around it, whose hashes of 95 bits decide.

Nothing is paired: a task packs its anchors, each once or twice, before the shuffle; those seen twice are joined back on
the hash. Windows are reduced to the least doc_id per hash, with partial sums before the shuffle, and joined back too. A passage that all documents share costs one row for each of its places. Copies of a whole
text are settled first: all but the least lose everything, and the least stands for them in the rest of the work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import Words, mix, slices, windows

LENGTH = 50
PERIOD = 31
#: A perfect difference set modulo 31 (fixed values; any difference cover would do).
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = LENGTH - PERIOD + 1
#: Anchors that a task packs at a time before they are shuffled.
PACK = 2_000_000
#: Stands for a null doc_id, which counts as larger than any other.
LAST = (1 << 63) - 1

_at_cover = np.zeros(PERIOD, dtype=bool)
_at_cover[list(COVER)] = True


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of all anchors of a slice and the words where they begin. Anchors only point to candidates."""
    place = np.flatnonzero(_at_cover[words.position() % PERIOD] & (words.left() >= ANCHOR))
    return (windows(words.hashes(), ANCHOR)[place] >> np.uint64(16)).astype(np.int64), place


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("doc").to_numpy(zero_copy_only=False), dtype=np.int64)


def _of_documents(batch: pa.RecordBatch, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each slice, (hash, document): each anchor hash of each document once, sorted by hash."""
    for words in slices(batch.column("text")):
        h, place = _anchors(words)
        if len(h):
            doc = ids[words.lo + words.row[place]]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
            yield h[new], doc[new]


def _packed(parts: int):
    """Anchor hashes of up to PACK at a time, each once, dealt to parts by value: (part, six bytes a hash).

    A hash that several of these documents have is written twice, so that seeing a hash twice means it is shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            third = np.zeros(len(h), dtype=bool)
            third[2:] = (h[2:] == h[1:-1]) & (h[1:-1] == h[:-2])
            h = h[~third]
            part = (mix(h) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            h, part = h[order], part[order]
            at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            six = np.ascontiguousarray(h.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6])
            return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array([x.tobytes() for x in np.split(six, at[1:])], pa.binary())], ["part", "hashes"])

        for batch in batches:
            for h, _ in _of_documents(batch, _ids(batch)):
                held.append(h)
                if sum(map(len, held)) >= PACK:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return run


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes that occur twice in a partition of packed rows. All packs of a hash are in one partition."""
    held = [np.frombuffer(x.as_buffer(), dtype=np.uint8).reshape(-1, 6) for batch in batches for x in batch.column("hashes")]
    if held:
        six = np.concatenate(held)
        h = np.zeros((len(six), 8), dtype=np.uint8)
        h[:, :6] = six
        h = np.sort(h.view("<i8").ravel())
        again = np.unique(h[1:][h[1:] == h[:-1]])
        for lo in range(0, len(again), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(again[lo : lo + 65536])], ["h"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor hash of each document once."""
    for batch in batches:
        for h, doc in _of_documents(batch, _ids(batch)):
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc)], ["h", "doc"])


def _in_lists(values: np.ndarray, rows: np.ndarray, lists: pa.Array, lo: int, n: int) -> np.ndarray:
    """Whether values[i] is in the list of row rows[i]. Lists come from the batch's rows lo..lo+n-1; null is empty."""
    part = lists.slice(lo, n)
    size = np.asarray(part.value_lengths().fill_null(0))
    flat = np.asarray(part.flatten(), dtype=np.int64)
    if not len(flat):
        return np.zeros(len(values), dtype=bool)
    code = np.unique(flat)  # ranks of values, so that row and value fit one integer
    rank = np.searchsorted(code, values)
    found = (rank < len(code)) & (code[np.minimum(rank, len(code) - 1)] == values)
    keys = np.unique(np.repeat(np.arange(n), size) * (len(code) + 1) + np.searchsorted(code, flat))
    key = rows * (len(code) + 1) + rank
    spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return found & (keys[spot] == key)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """95-bit hashes of the windows of LENGTH words that hold a shared anchor, each once per document."""
    for batch in batches:
        ids = _ids(batch)
        shared = batch.column("shared")
        for words in slices(batch.column("text")):
            part = shared.slice(words.lo, words.rows)
            if part.null_count == words.rows or not len(words.start):
                continue
            h, place = _anchors(words)
            place = place[_in_lists(h, words.row[place], shared, words.lo, words.rows)]
            n = len(words.start)
            mark = np.zeros(n + 1, dtype=np.int64)  # a shared anchor at p makes the windows from p - PERIOD + 1 to p candidates
            np.add.at(mark, np.maximum(place - PERIOD + 1, words.first[words.row[place]]), 1)
            np.add.at(mark, place + 1, -1)
            at = np.flatnonzero((np.cumsum(mark[:n]) > 0) & (words.left() >= LENGTH))
            if not len(at):
                continue
            a = windows(words.hashes(0), LENGTH, 0)[at].view(np.int64)
            b = (windows(words.hashes(1), LENGTH, 1)[at] >> np.uint64(33)).astype(np.int32)
            doc = ids[words.lo + words.row[at]]
            order = np.lexsort((b, a, doc))
            a, b, doc = a[order], b[order], doc[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (doc[1:] != doc[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(doc[new])], ["a", "b", "doc"])


def _strip(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, copy = batch.column("gone"), np.asarray(batch.column("copy").to_numpy(zero_copy_only=False), dtype=bool)
            for words in slices(batch.column("text")):
                n = len(words.start)
                keep = np.ones(n, dtype=bool)
                part = gone.slice(words.lo, words.rows)
                if part.null_count < words.rows and n:
                    at = np.flatnonzero(words.left() >= LENGTH)
                    h = windows(words.hashes(0), LENGTH, 0)[at].view(np.int64)
                    at = at[_in_lists(h, words.row[at], gone, words.lo, words.rows)]
                    mark = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + LENGTH, -1)
                    keep = np.cumsum(mark[:n]) == 0
                keep &= ~(copy[words.lo + words.row] & (words.count[words.row] >= LENGTH))
                kept_before = np.r_[0, np.cumsum(keep)]
                removed = words.count - (kept_before[words.first[1:]] - kept_before[words.first[:-1]])
                texts = [words.text(keep, r) for r in range(words.rows)]
                last = [hashlib.sha256(t).hexdigest() for t in texts] if digest else [t.decode() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(words.lo, words.rows), pa.array(words.count), pa.array(removed), pa.array(last, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the kept words joined by one space (with digest: their SHA-256).

    A word goes if a window of LENGTH words over it also begins in a document of smaller doc_id. Windows are judged on
    the input. A null text has no words; a null doc_id counts as larger than any other; rows of equal doc_id don't
    remove each other's words, and each gets its own row. Other columns are not read. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    light = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(text_col).alias("text"))
    keys = light.select("doc", F.md5("text").alias("key"))
    least = keys.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("key", "least")
    copies = keys.join(least, "key").where("doc > least").groupBy("doc").agg(F.collect_set("key").alias("copied"))
    # the texts are shuffled once: every step below reads the same exchange, so all must want the same columns of it
    whole = light.repartition("doc").join(copies, "doc", "left").select("doc", "text", F.coalesce(F.array_contains("copied", F.md5("text")), F.lit(False)).alias("copy"))
    sole = whole.where("not copy").select("doc", "text")
    parts = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shared = sole.mapInArrow(_packed(parts), "part int, hashes binary").repartition(parts, "part").mapInArrow(_twice, "h long")
    marks = sole.mapInArrow(_by_document, "h long, doc long").join(shared, "h", "left_semi").groupBy("doc").agg(F.collect_list("h").alias("shared"))
    found = whole.join(marks, "doc", "left").where("not copy").select("doc", "text", "shared").mapInArrow(_candidates, "a long, b int, doc long")
    firsts = found.groupBy("a", "b").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("a", "b", "lo")
    gone = found.join(firsts, ["a", "b"]).where("doc > lo").groupBy("doc").agg(F.collect_list("a").alias("gone"))
    tail = "kept_sha256 string" if digest else "kept string"
    return whole.join(gone, "doc", "left").select(F.when(F.col("doc") != LAST, F.col("doc")).cast(kind).alias("doc_id"), "text", "copy", "gone").mapInArrow(_strip(digest), f"doc_id {kind}, n_words long, n_removed long, {tail}")

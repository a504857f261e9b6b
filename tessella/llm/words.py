"""Words of whole texts and their hashes, vectorised over Arrow string buffers.

A word is a run of bytes other than space and \\t..\\r. Texts are taken from the Arrow buffer as they are, without a
Python object per row or word. Hashes are sums of b_i * P**i modulo 2**64 over random numbers b_i that stand for the
byte values (or for words), so the hash of any window comes from two prefix sums; a bijective mixer follows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64
#: Bytes of text worked on at once (a longer text is worked on alone), and rows at most.
SLICE_BYTES, SLICE_ROWS = 1 << 19, 1 << 13

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_P = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and so would their peaks."""
    for which, have in list(_tables.items()):
        if len(have[0]) > 2 * SLICE_BYTES:  # made for a long text
            del _tables[which]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, with freed memory given back when the task ends."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return bounded


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """frugal(run) over all columns of df, which it gives back in the same order; columns are known by place, so they may
    have any names."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(frugal(run), plain.schema).toDF(*df.columns)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**0..P**n and the inverses, modulo 2**64."""
    have = _tables.get(which)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        p, inv = np.full(size, _P[which], dtype=U), np.full(size, pow(_P[which], -1, 1 << 64), dtype=U)
        p[0] = inv[0] = 1
        have = _tables[which] = (np.multiply.accumulate(p), np.multiply.accumulate(inv))
    return have


_BYTE_VALUE = tuple(mix(np.arange(256, dtype=U) + U(1 + 1000 * k)) for k in (0, 1))


class Words:
    """Words of rows `lo`..`hi` of a batch; row r of the slice has the words first[r]..first[r+1]-1."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int):
        self.lo, self.rows = lo, len(offsets) - 1
        base = int(offsets[0])
        self.data = data[base : int(offsets[-1])]
        cut = offsets - base
        self.byte_ends = cut[1:]
        word = ~_SPACE[self.data]
        n = len(word)
        begins = np.zeros(n + 1, dtype=bool)
        begins[cut] = True  # a row's first byte never continues a word of the row before
        start = word.copy()
        start[1:] &= ~word[:-1] | begins[1:n]
        self.start = np.flatnonzero(start)
        stop = word.copy()
        stop[:-1] &= ~word[1:] | begins[1:n]
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, cut).astype(np.int64)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of every word; which selects one of two independent ones."""
        n = len(self.data)
        power, inverse = _powers(which, n)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(_BYTE_VALUE[which][self.data] * power[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])

    def position(self) -> np.ndarray:
        """Of every word, its place in its row."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.count)

    def left(self) -> np.ndarray:
        """Of every word, the words from it to the end of its row, itself included."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))

    def text(self, keep: np.ndarray, row: int) -> bytes:
        """The kept words of a row, joined by one space."""
        i = np.flatnonzero(keep[self.first[row] : self.first[row + 1]]) + self.first[row]
        raw = self.data.tobytes() if len(self.data) < 4096 else None
        if raw is None:
            if not len(i):
                return b""
            a, b = int(self.start[i[0]]), int(self.end[i[-1]])
            raw, shift = self.data[a:b].tobytes(), a
        else:
            shift = 0
        return b" ".join([raw[s:e] for s, e in zip((self.start[i] - shift).tolist(), (self.end[i] - shift).tolist())])


def windows(h: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of the `length` values from each place on; at places with fewer left, the value means nothing."""
    n = len(h)
    out = np.zeros(n, dtype=U)
    if n >= length:
        power, inverse = _powers(which, n)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum(h * power[:n], out=sums[1:])
        out[: n - length + 1] = mix((sums[length:] - sums[: n - length + 1]) * inverse[: n - length + 1])
    return out


def slices(text: pa.Array) -> Iterator[Words]:
    """All rows of a string column, in slices of about SLICE_BYTES. A null text has no words."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if pa.types.is_string(text.type):
        kind = np.int32
    else:
        text, kind = text.cast(pa.large_string()), np.int64
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, dtype=kind, count=text.offset + n + 1)[text.offset :].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1), lo + SLICE_ROWS, n)
        yield Words(data, offsets[lo : hi + 1], lo)
        lo = hi

"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

For a piece of n symbols the leaves hold rank * width + position of each adjacent pair; the root is then the leftmost
pair of lowest rank. A merge changes three leaves, each in O(log n), so even a piece of a million letters takes
O(n log n). Pieces repeat, so their ids are kept in a bounded table per Python worker, in two generations: what is met
again moves to the new one, and when that is full, the old one goes.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessella.llm.words import frugal

#: Pieces kept per worker, and the longest piece (in bytes) that is kept.
CACHE_PIECES, CACHE_BYTES = 300_000, 64

_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same for ASCII texts, where the standard library's engine is faster.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def _byte_chars() -> dict[str, int]:
    """Vocabulary files of this kind write bytes as printable characters: printable ones as themselves, the rest from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON format (byte level)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = _byte_chars(), spec["model"]["vocab"]
        as_bytes = {i: bytes(chars[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        as_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [as_bytes.get(i, b"") for i in range(max(as_bytes) + 1)]
        one = {b: i for i, b in as_bytes.items() if len(b) == 1}
        self.byte_id = [one[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece, by repeated merges of the leftmost pair of lowest rank."""
        ids, n, merges = [self.byte_id[b] for b in piece], len(piece), self.merges
        if n < 2:
            return ids
        width = 1 << (n - 1).bit_length()
        none = 1 << 62
        tree = [none] * (2 * width)
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                tree[width + i] = m[0] * width + i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            i = width + leaf
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    return
                tree[i] = low
                i >>= 1

        while tree[1] != none:
            i = tree[1] % width
            j = after[i]
            ids[i] = merges[ids[i], ids[j]][1]
            ids[j] = -1
            k = after[i] = after[j]
            if tree[width + j] != none:
                put(j, none)
            value = none
            if k < n:
                before[k] = i
                if m := merges.get((ids[i], ids[k])):
                    value = m[0] * width + i
            put(i, value)  # it was the least of all, so it changes
            if (p := before[i]) >= 0:
                m = merges.get((ids[p], ids[i]))
                value = m[0] * width + p if m else none
                if tree[width + p] != value:
                    put(p, value)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece that isn't in the new generation, as little-endian 32-bit integers."""
        out = self.old.get(piece)
        if out is None:
            raw = piece.encode()
            ids = self.merge(raw)
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(raw) > CACHE_BYTES:
                return out
        if len(self.new) >= CACHE_PIECES // 2:
            self.old, self.new = self.new, {}
        self.new[piece] = out
        return out

    def _plain(self, text: str) -> bytes:
        pieces = (_ASCII_PIECES if text.isascii() else _PIECES).findall(text)
        return b"".join([self.new.get(p) or self._piece(p) for p in pieces])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; special tokens that occur in the text become their ids."""
        if self.split_special is None or not self.split_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at path, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, decoded: bool = True) -> DataFrame:
    """Token ids of every whole text and the text decoded from them; doc_id, n_tokens, ids (array<int>), decoded.

    With digest, ids and decoded are replaced by ids_sha256 and decoded_sha256. Without decoded, a column `exact` that
    says whether the decoded text is the text takes its place. A null text counts as empty (no ids).
    Rows are independent: no shuffle, and repeated rows or ids give equal results. Other columns are not read.
    """
    tail = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string" if decoded else "ids array<int>, exact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = [bpe.encode(t or "") for t in texts]
            back = [bpe.decode(x) for x in ids]
            count = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(count)}
            if digest:
                out["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())
            else:
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), flat)
                if decoded:
                    out["decoded"] = pa.array(back, pa.string())
                else:
                    out["exact"] = pa.array([a == (b or "") for a, b in zip(back, texts)], pa.bool_())
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(frugal(run), f"doc_id {kind}, n_tokens long, {tail}")

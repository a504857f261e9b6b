"""Numbers that describe a text, vectorised over Arrow string buffers."""

from __future__ import annotations

import numpy as np

from tessella.llm.words import Words, windows

_CLASSES = "lower upper digit space newline stop comma shout ask quote bracket bar symbol joint lead rest".split()


def _class_table() -> np.ndarray:
    """Of each byte its class."""
    table = np.full(256, _CLASSES.index("rest"), dtype=np.uint8)
    for name, chars in (
        ("lower", bytes(range(97, 123))), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"), ("stop", b"."), ("comma", b",;"),
        ("shout", b"!"), ("ask", b"?"), ("quote", b"\"'`"), ("bracket", b"()[]{}<>"), ("bar", b"|"), ("symbol", b"#$%&*+=@^~\\/_"), ("joint", b"-:"), ("lead", bytes(range(0xC0, 0x100))),
    ):
        table[list(chars)] = _CLASSES.index(name)
    return table


_TABLE = _class_table()
NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "newline", "stop", "comma", "shout", "ask", "quote", "bracket", "bar", "symbol", "joint", "lead", "rest",
    "letters", "line_bytes", "distinct_words", "distinct_runs", "long_words", "capital_words", "tagged_words",
)


def features(words: Words) -> np.ndarray:
    """Rows x len(NAMES); an empty text has zeros. Shares are of the bytes or of the words of the text."""
    n, data = words.rows, words.data
    ends = words.byte_ends
    size = np.diff(np.r_[0, ends]).astype(float)
    row = np.repeat(np.arange(n), np.diff(np.r_[0, ends]))
    counts = np.bincount(row * 16 + _TABLE[data], minlength=16 * n).reshape(n, 16).astype(float)
    per = counts / np.maximum(size, 1)[:, None]
    of = lambda name: per[:, _CLASSES.index(name)]
    many = words.count.astype(float)
    some = np.maximum(many, 1)
    length = (words.end - words.start).astype(float)
    share = lambda mask: np.bincount(words.row, weights=mask, minlength=n) / some
    h = words.hashes()

    def distinct(value: np.ndarray, rows: np.ndarray) -> np.ndarray:
        key = np.sort((rows.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))
        new = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        return np.bincount((new >> np.uint64(48)).astype(np.int64), minlength=n) / np.maximum(np.bincount(rows, minlength=n), 1)

    at = np.flatnonzero(words.left() >= 5)
    first, second, last = (_TABLE[data[i]] for i in (words.start, np.minimum(words.start + 1, words.end - 1), words.end - 1))
    tail = [_CLASSES.index(x) for x in ("shout", "symbol", "bar")]
    capital, lower = _CLASSES.index("upper"), _CLASSES.index("lower")
    return np.column_stack([
        np.log1p(size), np.log1p(many), share(length), of("upper"), of("digit"), of("newline"), of("stop"), of("comma"), of("shout"), of("ask"), of("quote"), of("bracket"), of("bar"), of("symbol"),
        of("joint"), of("lead"), of("rest"), of("lower") + of("upper") + of("lead"), np.log1p(size / (1 + counts[:, _CLASSES.index("newline")])), distinct(h, words.row),
        distinct(windows(h, 5)[at], words.row[at]), share(length > 12), share((first == capital) & (second != lower) & (length > 1)), share(np.isin(last, tail)),
    ])

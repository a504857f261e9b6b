"""Quality scores by a generalised additive model with pairwise interactions.

Each feature is cut into bins at quantiles. Cyclic gradient boosting visits the features in turn; each visit fits a
shallow tree to the log-loss gradient over that feature's bins and adds a small step to the feature's lookup table. The
pairs whose two cuts explain most of what is left then get tables of their own in the same way. A score is a sum of
table entries: one lookup and addition per feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.features import NAMES, features
from tessella.llm.words import slices

#: Labelled rows that the model is fitted on at most: those least by a hash of doc_id. All documents are scored.
MAX_LABELLED = 8192
BINS, ROUNDS, RATE, LEAVES = 24, 150, 0.1, 4
PAIRS, PAIR_ROUNDS, PAIR_BINS = 8, 60, 8
MIN_WEIGHT, RIDGE = 5.0, 1.0


def _bins(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, x, side="right")


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Newton steps per bin of a tree of at most LEAVES leaves, grown by best gain on the bins' sums."""
    out, spans = np.zeros(len(g)), [(0, len(g))]
    cg, ch, cw = (np.r_[0, np.cumsum(v)] for v in (g, h, w))
    while len(spans) < LEAVES:
        best = (1e-6, None, None)
        for a, b in spans:
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            ok = (cw[m] - cw[a] >= MIN_WEIGHT) & (cw[b] - cw[m] >= MIN_WEIGHT)
            if ok.any():
                gain = _gain(cg[m] - cg[a], ch[m] - ch[a]) + _gain(cg[b] - cg[m], ch[b] - ch[m]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                k = int(np.argmax(np.where(ok, gain, -np.inf)))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (a, b), int(m[k]))
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, b in spans:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Best gain and steps of a tree with one cut on each of two axes, over the cells' sums."""
    cg, ch, cw = (np.cumsum(np.cumsum(v, 0), 1) for v in (g, h, w))
    parts = []
    for c in (cg, ch, cw):
        a = c[:-1, :-1]
        b, d, all_ = c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1]
        parts.append((a, b, d, all_ - a - b - d))
    ok = np.minimum.reduce(parts[2]) >= MIN_WEIGHT
    gain = sum(_gain(x, y) for x, y in zip(parts[0], parts[1])) - _gain(cg[-1, -1], ch[-1, -1])
    out = np.zeros(g.shape)
    if not ok.any():
        return 0.0, out
    i, j = np.unravel_index(int(np.argmax(np.where(ok, gain, -np.inf))), gain.shape)
    step = [x[i, j] / (y[i, j] + RIDGE) for x, y in zip(parts[0], parts[1])]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return float(gain[i, j]), out


class Gam:
    """Lookup tables of features and pairs; pickled to the executors (a few kB)."""

    def __init__(self, base: float = 0.0):
        self.base = base
        self.cuts: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate / (1 - rate)))
        if len(y) < 10 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = [_bins(c, k) for c, k in zip(x.T, cuts)]
        tables = [np.zeros(len(k) + 1) for k in cuts]
        score = np.full(len(y), self.base)

        def gradient() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                if len(tables[f]) < 2:
                    continue
                g, h = gradient()
                n = len(tables[f])
                step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, h, n), np.bincount(b, minlength=n).astype(float))
                tables[f] += step
                score += step[b]
        coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
        cell = [_bins(c, k) for c, k in zip(x.T, coarse)]

        def sums(i: int, j: int) -> list[np.ndarray]:
            g, h = gradient()
            shape = len(coarse[i]) + 1, len(coarse[j]) + 1
            at = cell[i] * shape[1] + cell[j]
            return [np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h, np.ones(len(y)))]

        wide = [i for i in range(len(cuts)) if len(coarse[i])]
        ranked = sorted(((_quadrants(*sums(i, j))[0], i, j) for n, i in enumerate(wide) for j in wide[n + 1 :]), reverse=True)
        chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in ranked[:PAIRS] if gain > 0]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in chosen:
                step = RATE * _quadrants(*sums(i, j))[1]
                table += step
                score += step[cell[i], cell[j]]
        self.cuts, self.tables = cuts, tables
        self.pairs = [(i, j, coarse[i], coarse[j], t) for i, j, t in chosen]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.base)
        for c, k, t in zip(x.T, self.cuts, self.tables):
            s += t[_bins(c, k)]
        for i, j, a, b, t in self.pairs:
            s += t[_bins(x[:, i], a), _bins(x[:, j], b)]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _rows(batches: Iterator[pa.RecordBatch], then) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in slices(batch.column("text")):
            yield then(batch.slice(words.lo, words.rows), features(words))


def held_out(id_col: str, folds: int, fold: int):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Gam:
    """The model, from at most MAX_LABELLED labelled rows that aren't held out. Their features, not texts, are collected."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).where(F.col("_id").isNotNull() & F.col("y").isNotNull())
    rows = rows.where(~held_out("_id", 3, 1)).orderBy(F.xxhash64("_id"), "_id", "y").limit(MAX_LABELLED)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(rows), F.col("doc") == F.col("_id")).select("text", "y", "_id")  # MAX_LABELLED rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda b, x: pa.RecordBatch.from_arrays([b.column("y"), b.column("_id").cast(pa.string()), pa.array(list(x), pa.list_(pa.float64()))], ["y", "id", "x"])
        return _rows(batches, flat)

    got = sorted(chosen.mapInArrow(run, "y double, id string, x array<double>").collect(), key=lambda r: (r["id"], r["y"], r["x"]))
    if not got:
        return Gam()
    return Gam().fit(np.array([r["x"] for r in got]), (np.array([r["y"] for r in got]) > 0.5).astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score (higher: label 1 likelier), predicted (1 from 0.5 on).

    Only the text enters a score: equal texts have equal scores. A null text is scored as an empty one; a null doc_id
    is not held out. Without usable labels of both kinds all scores are the labels' smoothed rate (0.5 without any).
    Repeated rows each get a row. Other columns are not read. An empty table gives no rows.
    """
    model = fit_quality(docs, labels, label_col, id_col, text_col)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(b: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
            s = model.score(x)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return _rows(batches, one)

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, 3, 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")

"""Language identification of whole, possibly mixed texts.

Script ranges narrow each word's candidate languages to those seen to use its script. A word's score under a language is
the log-likelihood of its byte trigrams (case folded, word ends included). Viterbi with a penalty for each switch labels
every word of a text, so spans of different languages come out as such. The document's language is the one whose spans
hold most letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import Words, frugal, map_rows, slices

#: Training documents per language at most, those least by a hash of doc_id. All documents are scored.
MAX_PER_LANGUAGE = 1500
#: Bits of a digit of a row's place in its language's hash order; a place has three digits.
DIGIT = 10
#: Languages at most; more is an error.
MAX_LANGUAGES = 256
BUCKETS = 1 << 16
PENALTY = 12.0
SMOOTH = 0.05
#: Share of a language's training words that must be in a script for the language to be a candidate there.
SCRIPT_SHARE = 0.005
#: Bytes of text that go through one run of Viterbi, whose steps are as many as the longest text's words.
VITERBI_BYTES = 3 << 20

SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "eastern", "other")


def _scripts() -> np.ndarray:
    """Of each byte, the script of letters that begin with it in UTF-8 (fixed ranges); 255 for none."""
    out = np.full(256, 255, dtype=np.uint8)
    for first, last, name in (
        (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC3, 0xCA, "latin"), (0xCD, 0xCF, "greek"), (0xD0, 0xD4, "cyrillic"), (0xD5, 0xD5, "armenian"),
        (0xD6, 0xD7, "hebrew"), (0xD8, 0xDD, "arabic"), (0xE0, 0xE0, "indic"), (0xE1, 0xE1, "other"), (0xE3, 0xEA, "eastern"), (0xEB, 0xED, "eastern"), (0xF0, 0xF4, "other"),
    ):
        out[first : last + 1] = SCRIPTS.index(name)
    return out


_SCRIPT = _scripts()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[[b for b in range(256) if b < 0x80 and not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)]] = 0x20


def trigrams(words: Words) -> np.ndarray:
    """Of each byte, the bucket of the trigram that ends there; BUCKETS where it holds no letter. Case is folded for ASCII and for U+00C0..U+00DE."""
    b = _FOLD[words.data]
    after = np.r_[np.uint8(0), words.data[:-1]] == 0xC3
    b = np.where(after & (words.data >= 0x80) & (words.data <= 0x9E) & (words.data != 0x97), words.data + 0x20, b).astype(np.uint32)
    one, two = np.full(len(b), 0x20, dtype=np.uint32), np.full(len(b), 0x20, dtype=np.uint32)
    one[1:], two[2:] = b[:-1], b[:-2]
    firsts = np.r_[0, words.byte_ends[:-1]]
    firsts = firsts[firsts < len(b)]
    one[firsts] = two[firsts] = 0x20  # a text doesn't go on in the next
    two[firsts[firsts + 1 < len(b)] + 1] = 0x20
    code = (two << np.uint32(16)) | (one << np.uint32(8)) | b
    code *= np.uint32(0x9E3779B1)  # four bytes a byte of text: this is the largest array here
    out = (code >> np.uint32(16)).astype(np.int32)
    out[(b == 0x20) & (one == 0x20)] = BUCKETS
    return out


def scripts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, its most frequent script (255: no letter; the first on ties), and its letters, of each script's first bytes."""
    kind = _SCRIPT[words.data]
    at = np.flatnonzero(kind != 255)
    word = np.searchsorted(words.start, at, side="right") - 1
    n, k = len(words.start), len(SCRIPTS)
    counts = np.bincount(word * k + kind[at], minlength=n * k).reshape(n, k)
    return np.where(counts.sum(1) > 0, counts.argmax(1), 255), counts.sum(1)


class Model:
    """Log-likelihoods of trigrams by language, and candidates by script."""

    def __init__(self, languages: list[str], grams: np.ndarray, in_script: np.ndarray):
        self.languages = languages
        total = grams.sum(1, keepdims=True)
        self.table = np.zeros((BUCKETS + 1, max(1, len(languages))), dtype=np.float32)
        if languages:
            self.table[:BUCKETS] = np.log((grams + SMOOTH) / (total + SMOOTH * BUCKETS)).T
            fine = in_script / np.maximum(in_script.sum(1, keepdims=True), 1) >= SCRIPT_SHARE
            fine[:, ~fine.any(0)] = True  # a script that no language uses narrows nothing
            self.allowed = np.vstack([fine.T, np.ones((256 - len(SCRIPTS), len(languages)), bool)])

    def scores(self, words: Words, script: np.ndarray) -> np.ndarray:
        """Words x languages; languages that a word's script rules out are far behind."""
        gram = trigrams(words)
        out = np.empty((len(words.start), len(self.languages)), dtype=np.float32)
        stop = np.minimum(words.end + 1, len(gram))
        for k in range(len(self.languages)):
            sums = np.r_[0.0, np.cumsum(self.table[gram, k], dtype=np.float64)]
            out[:, k] = sums[stop] - sums[words.start]
        out[script == 255] = 0
        out[~self.allowed[script]] -= 1e4
        return out


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of each word. Texts are first[i]..first[i+1]-1; all go through each step together, longest first."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    label = np.zeros(len(score), dtype=np.int16)
    steps = int(count[0]) if len(count) else 0
    if not steps or score.shape[1] < 2:
        return label
    active = np.searchsorted(-count, -np.arange(steps), side="left")  # texts with more than t words
    stay, best = [], []
    state = score[begin[: active[0]]].astype(np.float64)
    end_state = np.zeros(len(order), dtype=np.int64)
    for t in range(1, steps + 1):
        now = int(active[t]) if t < steps else 0
        was = len(state)
        if now < was:
            end_state[now:was] = state[now:].argmax(1)
            state = state[:now]
        if t == steps:
            break
        top = state.argmax(1)
        jump = state[np.arange(now), top] - penalty
        keep = state >= jump[:, None]
        stay.append(keep), best.append(top.astype(np.int16))
        state = np.where(keep, state, jump[:, None]) + score[begin[:now] + t]
    at = np.zeros(len(order), dtype=np.int64)
    for t in range(steps - 1, -1, -1):
        now = int(active[t])
        new = int(active[t + 1]) if t + 1 < steps else 0
        if t + 1 < steps:
            rows = np.arange(new)
            at[:new] = np.where(stay[t][rows, at[:new]], at[:new], best[t])
        at[new:now] = end_state[new:now]
        label[begin[:now] + t] = at[:now]
    return label


def _last_places(known: DataFrame, languages: list[str]) -> dict[str, int]:
    """By language, the place u of its MAX_PER_LANGUAGE-th row (the last place, if it has fewer).

    Places are found digit by digit from counts, which are partial sums: no task ranks the rows of a language. A count
    per language and digit value comes to the driver.
    """
    prefix, want = dict.fromkeys(languages, 0), dict.fromkeys(languages, MAX_PER_LANGUAGE)
    for level in (2, 1, 0):
        now = known.sparkSession.createDataFrame(list(prefix.items()), "_lang string, _prefix int")
        digit = F.shiftright("u", level * DIGIT)
        rows = known.join(F.broadcast(now), (F.col("lang") == F.col("_lang")) & (F.shiftright("u", (level + 1) * DIGIT) == F.col("_prefix")))  # MAX_LANGUAGES rows
        counts: dict[str, dict[int, int]] = {x: {} for x in prefix}
        for r in rows.groupBy("lang", digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r["lang"]][r["d"]] = r["n"]
        for x in list(prefix):
            for d, n in sorted(counts[x].items()):
                prefix[x] = d
                if n >= want[x]:
                    break
                want[x] -= n
            else:
                del prefix[x]  # fewer rows than wanted: all are taken
        if not prefix:
            break
    return {x: prefix.get(x, (1 << 3 * DIGIT) - 1) for x in languages}


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model, from at most MAX_PER_LANGUAGE rows of each language with crc32(doc_id) mod 4 other than 2.

    A row whose id or lang is null teaches nothing. Rows that share the last one's place in the hash order are all taken.
    """
    taught = F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2)
    known = docs.where(taught).select(F.col(lang_col).cast("string").alias("lang"), F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 64 - 3 * DIGIT).cast("int").alias("u"), F.col(text_col).alias("text"))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPTS))))
    number = {x: i for i, x in enumerate(languages)}
    k = len(SCRIPTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            own = np.array([number[x] for x in batch.column("lang").to_pylist()])
            for words in slices(batch.column("text")):
                gram, (script, letters) = trigrams(words), scripts(words)
                row = np.repeat(np.arange(words.rows), np.diff(np.r_[0, words.byte_ends]))
                lang_of_byte, lang_of_word = own[words.lo + row], own[words.lo + words.row]
                for x in np.unique(own[words.lo : words.lo + words.rows]):
                    c = counts.setdefault(int(x), np.zeros(BUCKETS + k, dtype=np.int64))
                    g = gram[lang_of_byte == x]
                    c[:BUCKETS] += np.bincount(g[g < BUCKETS], minlength=BUCKETS)
                    s = script[(lang_of_word == x) & (letters > 0)]
                    c[BUCKETS:] += np.bincount(s, minlength=k)[:k]
        for x, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["l", "g", "n"])

    ends = docs.sparkSession.createDataFrame(list(_last_places(known.select("lang", "u"), languages).items()), "_lang string, _last int")
    texts = known.join(F.broadcast(ends), (F.col("lang") == F.col("_lang")) & (F.col("u") <= F.col("_last"))).select("text", "lang")  # MAX_LANGUAGES rows at most
    table = texts.mapInArrow(frugal(run), "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()  # languages x (BUCKETS + k) rows at most
    counts = np.zeros((len(languages), BUCKETS + k))
    counts[table["l"], table["g"]] = table["n"]
    return Model(languages, counts[:, :BUCKETS], counts[:, BUCKETS:])


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _together(batch: pa.RecordBatch) -> Iterator[list[Words]]:
    held, size = [], 0
    for words in slices(batch.column("text")):
        held.append(words)
        size += len(words.data)
        if size >= VITERBI_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _labelled(model: Model, batch: pa.RecordBatch) -> Iterator[tuple[list[Words], np.ndarray, np.ndarray, np.ndarray]]:
    """Slices with their words' labels and letters, and the place of each text's first word."""
    for held in _together(batch):
        kinds = [scripts(w) for w in held]
        score = np.concatenate([model.scores(w, s) for w, (s, _) in zip(held, kinds)])
        letters = np.concatenate([n for _, n in kinds])
        first = np.r_[0, np.cumsum(np.concatenate([w.count for w in held]))]
        yield held, viterbi(score, first), letters, first


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (share of the letters in spans of lang_pred), n_spans, mixed.

    lang_pred is `und`, with score 0, for a null text, one without any letter, or if no language could be learned. Ties
    go to the first language by code point. mixed lists the languages of the spans, most letters first. Only the text
    enters a prediction. A null doc_id is not held out. Repeated rows each get a row; other columns are not read; an
    empty table gives no rows.
    """
    model = model or fit_languages(docs, id_col, text_col, lang_col)
    kind, k = dict(docs.dtypes)[id_col], max(1, len(model.languages))
    names = np.array(model.languages or ["und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not model.languages:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int64)), pa.array([[]] * n, pa.list_(pa.string()))], ["doc_id", "held_out", "lang_pred", "score", "n_spans", "mixed"])
                continue
            for held, label, letters, first in _labelled(model, batch):
                n = len(first) - 1
                row = np.repeat(np.arange(n), np.diff(first))
                mass = np.bincount(row * k + label, weights=letters, minlength=n * k).reshape(n, k)
                total = mass.sum(1)
                top = mass.argmax(1)
                turn = np.r_[True, (label[1:] != label[:-1]) | (row[1:] != row[:-1])] if len(label) else np.zeros(0, bool)
                spans = np.bincount(row[turn], minlength=n)
                pred, score = names[top], mass[np.arange(n), top] / np.maximum(total, 1)
                lo, at = held[0].lo, 0
                for w in held:  # letters are counted by first bytes: a text is `und` only if it truly has none
                    high = np.bincount(np.repeat(np.arange(w.rows), np.diff(np.r_[0, w.byte_ends])), weights=(w.data >= 0x80), minlength=w.rows)
                    plain = np.bincount(w.row, weights=letters[first[at] : first[at + w.rows]], minlength=w.rows) if len(w.row) else np.zeros(w.rows)
                    ascii_ = np.isin(w.data, np.r_[65:91, 97:123])
                    sure = np.bincount(np.repeat(np.arange(w.rows), np.diff(np.r_[0, w.byte_ends])), weights=ascii_, minlength=w.rows) > 0
                    for r in np.flatnonzero(~sure):
                        text = batch.column("text")[w.lo + int(r)].as_py()
                        if not text or not high[r] or not _has_letter(text):
                            pred[at + r], score[at + r] = "und", 0.0
                        elif not plain[r]:
                            score[at + r] = 1.0 / k
                    at += w.rows
                rank = np.argsort(-mass, axis=1, kind="stable")
                mixed = [[names[j] for j in rank[r] if mass[r, j] > 0] for r in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), batch.column("held_out").slice(lo, n), pa.array(pred, pa.string()), pa.array(score.astype(float)), pa.array(spans), pa.array(mixed, pa.list_(pa.string()))], ["doc_id", "held_out", "lang_pred", "score", "n_spans", "mixed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(frugal(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_spans long, mixed array<string>")


def keep_identified(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is identified; those that are `und` go. lang becomes the prediction where it was null.

    Decisions are joined to no other table: each row is judged where it is, so no text is shuffled. Null texts and texts
    without a letter go; if no language can be learned, all do. Repeated rows are judged alike. Other columns pass
    through. An empty table gives no rows.
    """
    model = fit_languages(docs, id_col, text_col, lang_col)
    text_no, lang_no = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.languages)
        for batch in batches:
            one = pa.RecordBatch.from_arrays([batch.column(text_no)], ["text"])
            for held, label, letters, first in _labelled(model, one) if k else ():
                n = len(first) - 1
                row = np.repeat(np.arange(n), np.diff(first))
                mass = np.bincount(row * k + label, weights=letters, minlength=n * k).reshape(n, k)
                part = batch.slice(held[0].lo, n)
                texts = part.column(text_no)
                plain = pc.match_substring_regex(texts, "[A-Za-z]").fill_null(False).to_pylist()  # the others are looked at one by one
                keep = [p or (texts[i].is_valid and _has_letter(texts[i].as_py())) for i, p in enumerate(plain)]
                lang = [a if a is not None else model.languages[j] for a, j in zip(part.column(lang_no).to_pylist(), mass.argmax(1))]
                field = part.schema.field(lang_no)
                yield part.set_column(lang_no, field, pa.array(lang, field.type)).filter(pa.array(keep, pa.bool_()))

    return map_rows(docs, run)

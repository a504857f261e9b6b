"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Further candidates come from looser patterns:
written-out emails, national phone numbers, identity numbers, bank accounts and credentials. Labelers of three sorts
(regex shape and checksums, gazetteers, context) vote yes, no or nothing on every candidate. The votes of all candidates
of the corpus, counted by pattern, go to expectation-maximisation, which estimates each labeler's reliability and a
probability for each pattern; a logistic classifier over votes and shape, trained on these, decides on the spans.
Only the table of vote patterns, whose size is bounded by the labelers, comes to the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.words import frugal, map_rows
from tessella.session import cut_lineage

BASE = ("email", "ip", "card", "phone")
MORE = ("written_email", "national_phone", "identity", "account", "credential")
KINDS = (*BASE, *MORE)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, so the look behind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOOSE = {
    "written_email": re.compile(r"(?<![\w.])[A-Za-z][A-Za-z0-9._-]{0,63} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,24}){1,4}(?!\w)"),
    "national_phone": re.compile(r"(?<![\w+./-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    "identity": re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "account": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "credential": re.compile(r"(?i)(?<!\w)(?:token|api[_-]?key|secret|passwor[dt]|passwd|pwd) {0,3}[:=] {0,3}[\"']?[^\s\"']{8,}"),
}
_HINT = {"written_email": ("at",), "account": (), "credential": ("token", "key", "secret", "passw", "pwd")}

#: Gazetteer: words that announce a kind when they stand shortly before it (fixed values).
_CUES = {
    "written_email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "national_phone": ("phone", "tel", "call", "fax", "mobile", "cell", "anruf", "llame", "appel"),
    "identity": ("ssn", "social", "identity", "passport", "ausweis"),
    "account": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "credential": ("login", "auth", "config", "credential", "export", "set"),
    "email": ("mail", "contact", "write", "to", "from"),
    "ip": ("ip", "host", "server", "address", "from"),
    "card": ("card", "visa", "pay", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell"),
}
#: Values that look private but are examples (fixed values).
_DUMMY = ("xxx", "changeme", "example", "placeholder", "your", "0000000", "1234567", "none", "null", "<")
N_VOTES = 5
#: The vote of the checksum, of a number's rules or of a value's variety: what fails it is seldom real.
CHECK = 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted: leftmost non-overlapping per kind, failing matches dropped."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((lo, 0, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def _votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Votes of the labelers, 1, -1 or 0: shape, checksum, cue before, dummy value, surroundings; then two shape bits."""
    body, before = text[start:end], text[max(0, start - 24) : start].lower()
    digits = [c for c in body if c.isdigit()]
    shape = {
        "written_email": 1 if re.search(r"[\[(](?:at|dot)[\])]", body) else (-1 if body.islower() and body.count(" ") > 3 and len(body) > 40 else 0),
        "national_phone": 1 if body[:1] == "(" or body.count("-") == 2 else 0,
        "identity": 0,
        "account": 1 if " " in body or len(body) >= 18 else 0,
        "credential": 1 if digits and any(c.isalpha() for c in body) and ("=" in body or ":" in body) else -1,
        "phone": 1 if "(" in body or " " in body else 0,
        "ip": 1,
        "card": 1 if len(digits) in (13, 15, 16) else -1,
        "email": 1,
    }[kind]
    if kind in ("account", "card"):
        check = 1 if (_iban(body) if kind == "account" else luhn("".join(digits))) else -1
    elif kind == "identity":  # numbers that are never given out
        check = -1 if body[:3] in ("000", "666") or body[:1] == "9" or body[4:6] == "00" or body[-4:] == "0000" else 1
    elif kind == "national_phone":  # neither part begins with 0 or 1
        check = 1 if len(digits) == 10 and digits[0] > "1" and digits[3] > "1" else -1
    elif kind == "credential":
        value = re.split(r"[:=]\s*[\"']?", body, maxsplit=1)[-1]
        check = 1 if len(set(value)) >= 8 else -1
    else:
        check = 0
    cue = 1 if any(w in before or (kind == "credential" and w in body.lower()[:12]) for w in _CUES[kind]) else 0
    low = body.lower()
    dummy = -1 if any(w in low for w in _DUMMY) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    around = -1 if left.isalnum() or right.isalnum() else 1
    return (shape, check, cue, dummy, around, int(len(body) > 24), int(len(digits) >= 8))


def candidates(text: str) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(start, kind, end, votes) of base spans and further candidates, sorted."""
    base = base_spans(text)
    out = [(s, k, e, _votes(text, KINDS[k], s, e)) for s, k, e in base]
    low = None
    for k, kind in enumerate(MORE, len(BASE)):
        if kind == "identity" and "-" not in text:
            continue
        if kind in _HINT and _HINT[kind]:
            low = text.casefold() if low is None else low  # as (?i) folds case
            if kind == "written_email":
                if " dot " not in low and "[dot]" not in low and "(dot)" not in low:
                    continue
            elif not any(h in low for h in _HINT[kind]):
                continue
        for m in _LOOSE[kind].finditer(text):
            s, e = m.span()
            if kind != "credential" and any(a < e and s < b for a, _, b in base):
                continue  # a base span already covers it
            out.append((s, k, e, _votes(text, kind, s, e)))
    out.sort()
    return out


def reliabilities(votes: np.ndarray, count: np.ndarray, prior: float = 0.7, rounds: int = 200, trusted: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows; 1, -1, 0 = none) with counts.

    Returns each pattern's probability of yes, and each labeler's rates: rate[labeler, truth, vote + 1]. Labelers are
    independent given the truth; rates start from honest labelers and are smoothed, so empty cells are harmless. The
    rates of the trusted labelers, which rarely err, are held near their start by as much weight as all candidates have.
    """
    n = votes.shape[1]
    rate = np.empty((n, 2, 3))
    rate[:, 1], rate[:, 0] = (0.1, 0.3, 0.6), (0.6, 0.3, 0.1)
    hold = np.full(n, 5.0)
    for j in trusted:
        rate[j, 1], rate[j, 0], hold[j] = (0.02, 0.3, 0.68), (0.68, 0.3, 0.02), max(5.0, float(count.sum()))
    start, p = rate.copy(), prior
    yes = np.full(len(votes), prior)
    for _ in range(rounds):
        like = [np.log(p if t else 1 - p) + sum(np.log(rate[j, t, votes[:, j] + 1]) for j in range(n)) for t in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        for t, w in ((0, count * (1 - new)), (1, count * new)):
            for j in range(n):
                cells = np.bincount(votes[:, j] + 1, weights=w, minlength=3) + hold[j] * start[j, t]
                rate[j, t] = cells / cells.sum()
        p = float(np.clip((count * new).sum() / count.sum(), 0.05, 0.95))
        if np.abs(new - yes).max() < 1e-9:
            break
        yes = new
    return yes, rate


def _design(kind: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Of each pattern: kind, votes for and against of each labeler, shape bits."""
    own = np.eye(len(KINDS))[kind]
    v = votes[:, :N_VOTES]
    return np.c_[own, v == 1, v == -1, votes[:, N_VOTES:]].astype(float)


def train_classifier(kind: np.ndarray, votes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic classifier on the patterns' probabilities, by Newton steps."""
    prob = np.empty(len(kind))
    for k in np.unique(kind):
        own = kind == k
        prob[own] = reliabilities(votes[own][:, :N_VOTES], count[own], trusted=(CHECK,))[0]
    x = _design(kind, votes)
    w, weight = np.zeros(x.shape[1]), count / count.max()
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (q - prob)) + 1e-3 * w
        step = np.linalg.solve(x.T @ (x * (weight * q * (1 - q))[:, None]) + 1e-3 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(patterns: DataFrame) -> dict[tuple[int, ...], bool]:
    """Which vote patterns are private, from a table (pattern, n) of all candidates of all documents."""
    found = sorted((r["pattern"], r["n"]) for r in patterns.groupBy("pattern").agg(F.sum("n").alias("n")).collect())
    if not found:
        return {}
    table = np.array([[int(x) for x in p.split(" ")] for p, _ in found])
    kind, votes, count = table[:, 0], table[:, 1:], np.array([n for _, n in found], dtype=float)
    w = train_classifier(kind, votes, count)
    return {tuple(int(x) for x in row): bool(s > 0) for row, s in zip(table, _design(kind, votes) @ w)}


def _pattern(kind: int, votes: tuple[int, ...]) -> str:
    return " ".join(map(str, (kind, *votes)))


def fit(docs: DataFrame, text_col: str = "text") -> dict[tuple[int, ...], bool]:
    """Which vote patterns are private, learned from all candidates of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column("text"):
                if t.is_valid:
                    seen.update(_pattern(k, v) for _, k, _, v in candidates(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    return learn(docs.select(F.col(text_col).alias("text")).mapInArrow(frugal(run), "pattern string, n long"))


def spans(text: str, private: dict[tuple[int, ...], bool]) -> list[tuple[int, int, int]]:
    """All spans of a text: base ones, and candidates whose pattern is private."""
    return [(s, k, e) for s, k, e, v in candidates(text) if k < len(BASE) or private.get((k, *v), False)]


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, span array<string>, kind array<int>, pattern array<string>"


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for v in values for x in v], kind))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text, the base spans' counts and digest, and all candidates: span, kind and vote pattern."""
    for batch in batches:
        out: dict[str, list] = {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "span": [], "kind": [], "pattern": []}
        for t in batch.column("text"):
            all_ = candidates(t.as_py()) if t.is_valid else []
            base = [x[:3] for x in all_ if x[1] < len(BASE)]
            for i, k in enumerate(BASE):
                out[f"n_{k}"].append(sum(x[1] == i for x in base))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["span"].append([_joined([x[:3]]) for x in all_])
            out["kind"].append([x[1] for x in all_])
            out["pattern"].append([_pattern(k, v) for _, k, _, v in all_])
        columns = [pa.array(out[f"n_{k}"], pa.int64()) for k in BASE]
        columns += [pa.array(out["base_sha256"], pa.string()), _lists(out["span"], pa.string()), _lists(out["kind"], pa.int32()), _lists(out["pattern"], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *out])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind; base_sha256 is over the base spans
    alone. A null text counts as empty. Each row is judged alone, so repeated rows give equal results, and a text of
    any length is read once, whole. Other columns are not read. An empty table gives no rows.

    The texts are read once: their candidates, which are few, are a table of their own, from which the model is learned
    and the spans are then chosen.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    light = cut_lineage(rows.mapInArrow(frugal(_found), f"doc_id {kind}, {_FOUND}"))
    private = learn(light.select(F.explode("pattern").alias("pattern"), F.lit(1).cast("long").alias("n")))
    chosen = F.array(*[F.lit(_pattern(p[0], p[1:])) for p, yes in sorted(private.items()) if yes and p[0] >= len(BASE)]).cast("array<string>")
    both = F.filter(F.arrays_zip("span", "kind", "pattern"), lambda x: (x["kind"] < len(BASE)) | F.array_contains(chosen, x["pattern"]))
    return light.select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", F.array_join(F.transform(both, lambda x: x["span"]), ",").alias("spans"))


def masked(text: str, private: dict[tuple[int, ...], bool]) -> str:
    """The text with every span replaced by <KIND>; overlapping spans become one, named after the first."""
    parts, at, until = [], 0, -1
    for s, k, e in spans(text, private):
        if s >= until:
            parts += [text[at:s], f"<{KINDS[k].upper()}>"]
        until = at = max(until, e)
    return "".join([*parts, text[at:]]) if parts else text


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by <KIND>; overlapping spans become one, named after the first.

    A null text stays null. n_chars, where there is such a column, follows the text. Every row stays, repeated ones as
    well; other columns pass through. An empty table gives no rows.
    """
    private = fit(docs, text_col)
    text_no = docs.columns.index(text_col)
    chars_no = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t.as_py(), private) if t.is_valid else None for t in batch.column(text_no)]
            field = batch.schema.field(text_no)
            out = batch.set_column(text_no, field, pa.array(texts, field.type))
            if chars_no is not None:
                field = batch.schema.field(chars_no)
                out = out.set_column(chars_no, field, pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(field.type))
            yield out

    return map_rows(docs, run)

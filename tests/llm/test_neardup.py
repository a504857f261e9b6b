"""op6: signatures are unbiased; classes equal those of a brute-force comparison of all pairs."""

import random
import re
from collections import Counter

import numpy as np

from tessella.llm import neardup, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    w = WORD.findall(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def likeness(a, b):
    both = sum((a & b).values())
    whole = sum((a | b).values())
    return both / whole if whole else 0.0


def brute(rows, threshold=0.8):
    texts = {}
    for i, t in sorted(rows):
        if t is not None:
            texts.setdefault(t, i)
    reps = sorted((i, t) for t, i in texts.items())
    bags = [bag(t) for _, t in reps]
    parent = {i: i for i, _ in reps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for j in range(len(reps)):
        for i in range(j):
            n, m = sum(bags[i].values()), sum(bags[j].values())
            if n and m and min(n, m) >= threshold * max(n, m) and likeness(bags[i], bags[j]) >= threshold:
                a, b = find(reps[i][0]), find(reps[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: i if t is None else find(texts[t]) for i, t in rows}


def run(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_signature_is_unbiased():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(40):
        e = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        wa, wb = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        sets.append((e, wa, wb))
    rows, els, ws = [], [], []
    for k, (e, wa, wb) in enumerate(sets):
        for r, w in ((2 * k, wa), (2 * k + 1, wb)):
            rows.append(np.full((w > 0).sum(), r)), els.append(e[w > 0]), ws.append(w[w > 0])
    sig = neardup.bag_minhash(np.concatenate(rows), neardup.mix(np.concatenate(els)), np.concatenate(ws), 80, m=512)
    assert np.isfinite(sig).all()
    want = [np.minimum(a, b).sum() / np.maximum(a, b).sum() for _, a, b in sets]
    got = [(sig[2 * k] == sig[2 * k + 1]).mean() for k in range(40)]
    assert abs(np.mean(np.array(got) - want)) < 0.01
    assert np.abs(np.array(got) - want).max() < 0.09


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = run(queries.queries()["op6_minhash_neardup"](spark, sf_dir))
    assert got == brute(rows)


def test_chains_and_large_groups(spark):
    """Near copies of copies, whose ends are unlike, stay one class; unlike texts stay apart."""
    rng = random.Random(2)
    rows = []
    for g in range(4):
        text = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for k in range(30):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            at = rng.randrange(140)
            text[at : at + 2] = [f"x{rng.randrange(10**6)}"]
    rows += [(1000 + i, t) for i, t in enumerate([None, None, "", "", " ", "one two", "one  two", "one two three", "a b c d e", "a b c d e f"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as key", "3 as u")
    got = run(neardup.near_duplicates(df.repartition(3)))
    assert got == brute(rows)
    kept = {r.doc_id for r in neardup.drop_near_duplicates(df).collect()}
    assert kept == {i for i, c in got.items() if i == c}
    assert run(neardup.near_duplicates(df.limit(0))) == {}


def test_large_group_of_middling_likeness(spark):
    """Copies with many edits: some pairs pass, most don't; classes are exactly the components."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.randrange(1, 5)):
            t[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    got = run(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute(rows)
    assert sum(got[i] == want[i] for i in want) >= 158 and len(set(want.values())) > 1

"""op3 against a brute-force version."""

import hashlib
import random
import re

from tessella.llm import queries, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=50):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][i : i + length]), d)
    out = {}
    for d, w in words.items():
        keep = [True] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                keep[i : i + length] = [False] * length
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out[d] = (len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
    return out


def run(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_cover_is_complete():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = run(queries.queries()["op3_substring"](spark, sf_dir))
    assert got == want
    assert sum(x[1] for x in got.values()) > 0


def test_edges(spark):
    rng = random.Random(3)
    passage = [f"w{rng.randrange(1000)}" for _ in range(50)]
    rest = lambda: [f"é{rng.randrange(10**6)}" for _ in range(rng.randrange(70))]
    rows = [(i, " ".join(rest() + passage[: rng.choice([49, 50, 50])] + rest())) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "a " * 400), (104, "a b " * 120), (105, "a " * 300), (106, " ".join(passage) + "\x85\x0b" + " ".join(passage))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("doc_id", "text", "1 as h", "'x' as shared")
    assert run(substring.remove_repeats(df.repartition(5), digest=True)) == brute(rows)
    assert run(substring.remove_repeats(df.limit(0), digest=True)) == {}


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed, r.kept) for r in substring.remove_repeats(df).collect())
    assert got == [(-1, 60, ""), (1, 0, text), (1, 0, text)]

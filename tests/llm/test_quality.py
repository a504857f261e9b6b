"""op4: held-out accuracy, and the cases that the docstring defines."""

import zlib

import numpy as np

from tessella.llm import quality, queries


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.queries()["op4_quality"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(g.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and g.predicted == int(g.score >= 0.5) and 0 <= g.score <= 1 for i, g in got.items())
    test = [(r.quality, got[r.doc_id].score) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    y, s = np.array(test).T
    print(len(y), auc(y, s), ((s >= 0.5) == y).mean())
    assert auc(y, s) > 0.85 and ((s >= 0.5) == y).mean() > max(y.mean(), 1 - y.mean())


def test_query_against_a_plain_version(spark, sf_dir):
    """The query's scores from features counted character by character and tables walked bin by bin."""
    import math
    import re

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    got = {r.doc_id: r for r in queries.queries()["op4_quality"](spark, sf_dir).collect()}
    groups = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "newline": "\n", "stop": ".", "comma": ",;", "shout": "!", "ask": "?", "quote": "\"'`", "bracket": "()[]{}<>", "bar": "|", "symbol": "#$%&*+=@^~\\/_", "joint": "-:", "space": " \t\r\x0b\x0c"}
    kind_of = {ord(c): k for k, chars in groups.items() for c in chars} | {b: "lead" for b in range(0xC0, 0x100)}

    def plain_features(text):
        data = (text or "").encode()
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
        n = {k: 0 for k in (*groups, "lead", "rest")}
        for b in data:
            n[kind_of.get(b, "rest")] += 1
        share = lambda k: n[k] / max(1, len(data))
        per_word = lambda f: sum(map(f, words)) / max(1, len(words))
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        first = ["upper", "digit", "newline", "stop", "comma", "shout", "ask", "quote", "bracket", "bar", "symbol", "joint", "lead", "rest"]
        capital = lambda w: len(w) > 1 and kind_of.get(w[0]) == "upper" and kind_of.get(w[1], "rest") != "lower"
        return [math.log1p(len(data)), math.log1p(len(words)), per_word(len), *map(share, first), share("lower") + share("upper") + share("lead"), math.log1p(len(data) / (1 + n["newline"])),
                len(set(words)) / max(1, len(words)), len(set(runs)) / max(1, len(runs)), per_word(lambda w: len(w) > 12), per_word(capital), per_word(lambda w: kind_of.get(w[-1]) in ("shout", "symbol", "bar"))]

    def place(x, cuts):
        return sum(c <= x for c in cuts)

    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        x = plain_features(r.text)
        s = model.base + sum(t[place(v, k)] for v, k, t in zip(x, model.cuts, model.tables)) + sum(t[place(x[i], a), place(x[j], b)] for i, j, a, b, t in model.pairs)
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-s))) < 1e-9, r.doc_id


def test_learns_a_pairwise_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    m = quality.Gam().fit(x[:3000], y[:3000])
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    assert {0, 1} == set(m.pairs[0][:2])


def test_edges(spark):
    docs = spark.createDataFrame([(i, f"word {i} text " * (1 + i % 5) if i % 2 else "BUY!! NOW!! " * (1 + i % 7)) for i in range(100)] + [(200, None), (201, ""), (None, "x"), (5, "word 5 text "), (202, "é" * 300_000)], "doc_id long, text string").selectExpr("*", "0 as y", "1 as score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (7, None)], "doc_id long, quality int").selectExpr("*", "'t' as text")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 105
    by = {r.doc_id: r for r in got}
    assert by[200].score == by[201].score and not by[None].held_out
    assert all(by[i].predicted == i % 2 for i in range(100))
    none = quality.score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0

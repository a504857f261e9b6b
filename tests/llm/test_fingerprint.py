"""op2: edited texts, fingerprints and likeness against a plain restatement; order at every length."""

import hashlib
import random
import re

import xxhash

from pyspark.sql import functions as F

from tessella.llm import fingerprint, queries


def edited(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out[i] = t[: len(t) - half] + nxt[:half]
    return out


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = edited(rows)
    got = {r.doc_id: r for r in queries.queries()["op2_fingerprints"](spark, sf_dir).collect()}
    assert set(got) == set(want)
    texts = {}
    for i, t in rows:
        g = got[i]
        assert g.n_chars == len(t)
        assert g.edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        assert texts.setdefault(t, g.fingerprint) == g.fingerprint
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        if want[i] == t:
            assert g.near_edited == 1 and g.fingerprint == g.edited_fingerprint
    assert sum(g.near_edited for g in got.values()) > 5 * sum(g.near_next for g in got.values()) / 2


def test_order_matters_and_repeats_are_numbered(spark):
    words = [f"w{i}" for i in range(300)]
    moved = words[150:] + words[:150]
    texts = [" ".join(words), " ".join(moved), " ".join(reversed(words)), "a b c " * 100, "a b c " * 50, "a  b\tc " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    f = {r.i: r.f for r in fingerprint.with_fingerprint(df, "t", "f").select("i", "f").collect()}
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(fingerprint.likeness("a", "b")).first()[0]
    assert pair(f[0], f[0]) == 1
    assert pair(f[0], f[1]) < 0.6 and pair(f[0], f[2]) == 0
    assert pair(f[3], f[5]) == 1 and pair(f[3], f[4]) < 1


def test_edges(spark):
    rows = [(5, None), (4, ""), (3, "x"), (2, "é" * 7), (1, "a b"), (0, "one two three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as b", "'z' as edited", "true as guest")
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(df.repartition(3)).collect()}
    want = edited(rows)
    assert {i: g.edited_sha256 for i, g in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert got[5].fingerprint == got[4].fingerprint == "" and got[5].near_next == 1 and got[3].near_next == 0
    assert fingerprint.fingerprint_documents(df.limit(0)).count() == 0
    one = fingerprint.fingerprint_documents(df.where("doc_id = 0")).first()
    assert one.near_next == 1 and one.n_chars == 18
    odd = spark.createDataFrame([(None, "a b c"), (1, "d e f"), (1, "d e f")], "doc_id long, text string")
    assert fingerprint.fingerprint_documents(odd).where(F.col("doc_id").isNull()).count() == 1


def true_omh(a, b, hashes=200):
    """Share of independent orders of all elements under which the L least, in text order, are the same."""

    def elements(words):
        seen, out = {}, []
        for i in range(len(words) - fingerprint.K + 1):
            k = tuple(words[i : i + fingerprint.K])
            seen[k] = seen.get(k, -1) + 1
            out.append((k, seen[k]))
        return out

    ea, eb = elements(a), elements(b)
    same = 0
    for seed in range(hashes):
        rng = random.Random(seed)
        order = {x: rng.random() for x in sorted({*ea, *eb})}
        pick = lambda e: [e[i][0] for i in sorted(sorted(range(len(e)), key=lambda i: order[e[i]])[: fingerprint.L])]
        same += pick(ea) == pick(eb)
    return same / hashes


def test_short_texts_keep_their_order(spark):
    """Halves swapped: likeness is that of Order MinHash with an order of all k-mers for each bin, at any length."""
    rng = random.Random(2)
    rows, want = [], {}
    for n in (10, 30, 50, 80, 150, 250):
        for i in range(12):
            words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            moved = words[n // 2 :] + words[: n // 2]
            rows.append((n, " ".join(words), " ".join(moved)))
            want.setdefault(n, []).append(true_omh(words, moved))
    df = spark.createDataFrame(rows, "n int, a string, b string").repartition(4)
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "a", "x"), "b", "y")
    got = df.groupBy("n").agg(F.avg(fingerprint.likeness("x", "y")).alias("near"), F.min(F.size("x")).alias("bins")).collect()
    for r in got:
        assert r.bins == 64
        assert abs(r.near - sum(want[r.n]) / 12) < 0.08, (r.n, r.near)


def test_few_words_are_cut_into_characters(spark):
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400))
    rows = [(a, a[:-4]), (a, a[200:] + a[:200]), ("é" + a, a), ("one two three four", "one  two three four")]
    df = spark.createDataFrame(rows, "a string, b string")
    near = [r[0] for r in fingerprint.with_fingerprint(fingerprint.with_fingerprint(df, "a", "x"), "b", "y").select(fingerprint.likeness("x", "y")).collect()]
    assert 0.8 < near[0] <= 1 and 0 < near[1] < 0.45 and near[2] > 0.8 and near[3] == 1


PLACE, MASK = 1 << fingerprint.PLACE_BITS, (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*values):
    """Spark's xxhash64 of longs, (int,) and strings: each value is hashed with the hash before as its seed."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return signed(seed)


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if 1 <= len(words) < fingerprint.MIN_WORDS:
        words = list(" ".join(words))
    k = fingerprint.K
    kmers = [hashed(*words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [hashed(*words)] if words else []
    seen, elements = {}, []
    for i, x in enumerate(kmers):
        name = x >> fingerprint.PLACE_BITS
        seen[name] = seen.get(name, -1) + 1
        elements.append((hashed(name, (seen[name],)) >> fingerprint.PLACE_BITS, i))  # numbered by occurrence
    by_bin = lambda rank, x: rank >> (58 - fingerprint.PLACE_BITS)
    out = []
    for b in range(-32, 32):
        order = []
        for deal in range(fingerprint.DEALS):
            ranks = [(e if deal == 0 else hashed(e, (deal,)) >> fingerprint.PLACE_BITS, i) for e, i in elements]
            order += [i for rank, i in sorted((r if deal == 0 else r >> 2 << 2, i) for r, i in ranks) if by_bin(rank, i) == b]
        order += [i for _, i in sorted((hashed(e, b) >> fingerprint.PLACE_BITS, i) for e, i in elements)]
        least = sorted(list(dict.fromkeys(order))[: fingerprint.L])
        if least:
            out.append(signed((b << 58 & MASK) | (hashed(*[kmers[i] for i in least]) & MASK) >> 6))
    return sorted(out)


def plain_likeness(a, b):
    bins = {x >> 58 for x in a} | {x >> 58 for x in b}
    return len(set(a) & set(b)) / len(bins) if bins else 1.0


def test_fingerprints_and_likeness_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = sorted(rows, key=lambda r: len(r[1]))[:130]  # the plain version takes a hash for every word and bin
    rows += [(10_000, ""), (10_001, "x"), (10_002, "a b c d e f g"), (10_003, "a b " * 40), (10_004, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprint_documents(df).collect()}
    of = {i: plain_fingerprint(t) for i, t in rows}
    of_edited = {i: plain_fingerprint(t) for i, t in edited(rows).items()}
    digits = lambda f: "".join(f"{(x & MASK) >> 24:010x}" for x in f)
    order = sorted(of, reverse=True)
    for k, i in enumerate(order):
        assert got[i].fingerprint == digits(of[i]) and got[i].edited_fingerprint == digits(of_edited[i])
        assert abs(got[i].near_edited - plain_likeness(of[i], of_edited[i])) < 1e-12
        assert abs(got[i].near_next - plain_likeness(of[i], of[order[(k + 1) % len(order)]])) < 1e-12


def test_halves_swapped_at_the_lengths_of_most_texts(spark):
    """Likeness of a text to itself with its halves swapped stays as low as Order MinHash makes it."""
    rng = random.Random(5)
    rows = []
    for n in (30, 60, 120, 300):
        for _ in range(25):
            w = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            rows.append((n, " ".join(w), " ".join(w[n // 2 :] + w[: n // 2])))
    df = fingerprint.with_fingerprint(fingerprint.with_fingerprint(spark.createDataFrame(rows, "n int, a string, b string"), "a", "x"), "b", "y")
    near = {r.n: r.near for r in df.groupBy("n").agg(F.avg(fingerprint.likeness("x", "y")).alias("near")).collect()}
    assert all(near[n] < 0.32 for n in near) and near[30] < 0.25, near

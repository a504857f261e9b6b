"""op9: targets by hand, sums against targets, exact quotas of the tree, reruns, edges."""

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import mixing, queries


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2.0) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([10, 1000], [3, 1], 1.5, 2.0) == [20.0, 1495.0]
    assert mixing.targets([0, 10], [3, 1], 1.5, 2.0) == [0.0, 15.0] and mixing.targets([], [], 1.5, 2.0) == []
    t = mixing.targets([5, 50, 500, 7], [3, 1, 2, 3], 1.5, 2.0)
    assert abs(sum(t) - 1.5 * 562) < 1e-9 and all(a <= 2 * b + 1e-9 for a, b in zip(t, [5, 50, 500, 7]))


def test_splitting_tree_keeps_quotas():
    blocks = np.array([1000, 37, 0, 251])
    q = mixing.split_quotas(blocks, 16, 3)
    assert (q.sum(1) == blocks).all() and (q >= 0).all() and q.sum(0).max() - q.sum(0).min() <= 4
    assert (q == mixing.split_quotas(blocks, 16, 3)).all() and (q != mixing.split_quotas(blocks, 16, 4)).any()
    mean = np.mean([mixing.split_quotas(np.array([320, 160]), 16, s)[:, 0] for s in range(200)], axis=0)
    assert abs(mean[0] - 20) < 0.5 and abs(mean[1] - 10) < 0.5


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    size = {i: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text)]) for i, r in docs.items()}
    names = sorted({r.source for r in docs.values()})
    total = {s: sum(size[i] for i, r in docs.items() if r.source == s) for s in names}
    goal = dict(zip(names, mixing.targets([total[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2.0)))
    got = queries.queries()["op9_mixing"](spark, sf_dir).collect()
    assert sorted(got) == sorted(queries.queries()["op9_mixing"](spark, sf_dir).collect())
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = docs[r.doc_id].source
        assert (r["size"], r.source_size) == (size[r.doc_id], total[s]) and abs(r.target - goal[s]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert len(got) == len(docs) and all(abs(taken[s] - goal[s]) <= 0.5 for s in names)


def test_blocks_of_shards_are_disjoint_and_edges(spark):
    rows = [(i, "w " * (1 + i * 13 % 90), "ab"[i % 2]) for i in range(300)] + [(900, None, "a"), (901, "", "b"), (902, "one two", None), (None, "x y z", "a"), (903, "solo " * 5000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "3 as draws")
    p = mixing.mix_sources(df.repartition(3), n_shards=4)
    got = {r.doc_id: r for r in p.collect()}
    assert len(got) == 305 and got[900].taken == 0 and got[901].taken == 0 and got[902]["size"] == 2
    sums = {}
    for r in got.values():
        sums[r.source] = sums.get(r.source, 0) + r.taken
        assert sum(d.words for d in r.draws) == r.taken and all(0 <= d.shard < 4 for d in r.draws)
        pieces = sorted((d["copy"], d.start, d.words) for d in r.draws)  # those of a copy don't overlap
        assert all(a[0] != b[0] or a[1] + a[2] <= b[1] for a, b in zip(pieces, pieces[1:])) and all(a + n <= r["size"] for _, a, n in pieces)
    targets = {r.source: r.target for r in got.values()}
    assert all(abs(sums[s] - targets[s]) <= 1 for s in sums) and None in targets
    assert sorted(map(str, got.values())) == sorted(map(str, mixing.mix_sources(df.repartition(9), n_shards=4).collect()))
    mixed = mixing.mixed_documents(df.select("doc_id", "text", "source").where("doc_id is not null"))
    words = mixed.select(F.sum(F.size(F.array_remove(F.split(F.trim("text"), " +"), "")))).first()[0]
    assert abs(words - 1.5 * sum(len((t or "").split()) for i, t, _ in rows if i is not None)) <= 4
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_permutation_and_draws_of_any_size():
    for n in (1, 2, 3, 7, 100, 1023):
        x = np.arange(n)
        at = mixing.permuted(x, np.full(n, n), np.full(n, 5, dtype=np.uint64))
        assert sorted(at) == list(range(n))
        assert n < 100 or (at != mixing.permuted(x, np.full(n, n), np.full(n, 6, dtype=np.uint64))).any()
    rng = np.random.default_rng(1)
    for good, bad, n in ((5, 7, 4), (300, 20, 310), (0, 9, 3), (9, 0, 3), (40, 60, 50)):
        got = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(4000)])
        want = np.random.default_rng(2).hypergeometric(good, bad, n, 4000)
        assert abs(got.mean() - want.mean()) < 0.15 and abs(got.std() - want.std()) < 0.15
    big = [mixing.hypergeometric(rng, 4 * 10**10, 6 * 10**10, 5 * 10**10) for _ in range(20)]
    assert abs(np.mean(big) - 2 * 10**10) < 5e5 and len(set(big)) == 20


def test_every_shard_gets_its_blocks():
    """Pieces against the tree's quotas, shard by shard, and against the stream, word by word."""
    rng = np.random.default_rng(3)
    sizes, n_shards = [100_003, 4096, 30_000, 500], 5
    goals = mixing.targets(sizes, [3, 1, 2, 3], 1.5, 2.0)
    plan = mixing.Plan(sizes, goals, n_shards, 9)
    quotas = mixing.split_quotas(plan.passes * plan.blocks + plan.drawn, n_shards, 9)
    for no, size in enumerate(sizes):
        ends = np.unique(np.r_[rng.integers(1, size, size // 300), size])
        start = np.r_[0, ends[:-1]]
        d = plan.draws(np.full(len(ends), no), start, ends - start, rng.integers(0, 1 << 60, len(ends)))
        seen, blocks = {}, {s: set() for s in range(n_shards)}
        for r, c, at, n, shard in zip(d["row"], d["copy"], d["start"], d["words"], d["shard"]):
            first = start[r] + at
            assert n > 0 and first + n <= ends[r] and first // mixing.BLOCK_WORDS == (first + n - 1) // mixing.BLOCK_WORDS
            blocks[int(shard)].add((int(c), int(first // mixing.BLOCK_WORDS)))
            for w in range(first, first + n):
                assert (c, w) not in seen
                seen[c, w] = shard
        assert len(seen) == round(goals[no])
        assert [len(blocks[s]) for s in range(n_shards)] == quotas[no].tolist()
        assert all((c, w) in seen for c in range(plan.passes[no]) for w in range(size))
    shard_blocks = quotas.sum(0)
    assert shard_blocks.max() - shard_blocks.min() <= 3


def test_mixed_documents_by_shard(spark):
    """Pieces rebuild the texts; shards lie together; repeated ids, any column names, very long texts."""
    long_ = "".join(f" x{i}\t" for i in range(9000))
    rows = [(7, "one  two", "a", 8), (7, "one  two", "a", 8), (7, "other é", "b", 7), (8, long_, "a", len(long_)), (None, "n", "b", 1), (9, None, "a", None), (10, "", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").selectExpr("*", "1 as _d", "2 as _id", "3 as _size", "4 as _row", "5 as _shard", "6 as `a.b`")
    plan = mixing.mix_sources(df, n_shards=3)
    draws = [(r.doc_id, d["copy"], d.start, d.words, d.shard) for r in plan.collect() for d in r.draws]
    out = mixing.mixed_documents(df, shard_col="shard", n_shards=3)
    assert out.columns == [*df.columns, "shard"]
    got = out.withColumn("p", F.spark_partition_id()).collect()
    assert len(got) == len(draws) and all(r.n_chars == len(r.text) and (r._d, r._id, r["a.b"]) == (1, 2, 6) for r in got)
    assert {r.doc_id for r in got} == {7, 8, None}
    words = lambda s: sum(len(r.text.split()) for r in got if r.shard == s)
    assert [words(s) for s in range(3)] == [sum(n for *_, n, shard in draws if shard == s) for s in range(3)]
    order = [(r.p, r.shard) for r in got]
    assert order == sorted(order)
    size = 9000 + 2 + 2
    assert plan.where("source = 'a'").agg(F.sum("taken")).first()[0] == round(mixing.targets([size, 3], [3, 1], 1.5, 2.0)[0])
    pieces = sorted((d["copy"], d.start, d.words) for d in plan.where("doc_id = 8").first().draws)
    whole = [p for p in pieces if p[0] == 0]
    assert sum(n for *_, n in whole) == 9000  # the first pass is a whole one
    texts = {len(r.text.split()): r.text for r in got if r.doc_id == 8}
    assert all(t in long_ for t in texts.values())
    again = mixing.mixed_documents(df.repartition(5), n_shards=3).collect()
    assert sorted(r.text for r in again) == sorted(r.text for r in got)
    assert mixing.mixed_documents(df.limit(0)).count() == 0

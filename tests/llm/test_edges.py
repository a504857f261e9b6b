"""The cases that every operator and every stage of the pipeline defines: nulls in any column, empty and very long texts,
ties and repeated rows, an empty table, and further columns whose names are those that the code uses inside."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, fingerprint, langid, mixing, neardup, pii, quality, queries, sharding, substring

corpus_pipeline = pytest.importorskip("corpus_pipeline")

INSIDE = (
    "doc key text_u text_v u v w h node root band hash part least bands edited guest b n_words copied copy shared gone _bucket _offset _d _id _size _row _of _no _start _total _target _shard _position _gone _key _of2 score held_out pred size draws taken span kind "
    "pattern row_no n_rows _place label y _lang _last x `a.b`"
).split()
BASE = "doc_id long, text string, lang string, source string, n_chars long"


def make(seed, n, words=("ka", "lo", "mi", "su", "te", "ro", "na")):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(words) for _ in range(3)) for _ in range(n))


LONG = make(99, 60_000)
ROWS = [(i, make(i, 30 + i % 50), "aa", "one") for i in range(30)] + [(i, make(i, 40, ("the", "ing", "er", "wo")), "bb", "two") for i in range(30, 60)]
ROWS += [(100, None, "aa", "one"), (101, "", None, None), (102, " \n\t ", "bb", "two"), (103, LONG, "aa", "one"), (104, LONG, "aa", None), (None, make(3, 33), None, "two"), (None, None, None, None), (105, "12 + 3", None, "one")]
ROWS += [(5, make(5, 35), "aa", "one")] * 3 + [(6, make(600, 60), "aa", "two"), (107, make(7, 37), None, "one"), (108, "mail ann@example.org or +1 (555) 123-4567", "aa", "one")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in ROWS], BASE)
    return df.selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(INSIDE)]).repartition(5).cache()


OPERATORS = {
    "op1": lambda d: sharding.shard_rows(d),
    "op2": lambda d: fingerprint.fingerprint_documents(d),
    "op3": lambda d: substring.remove_repeats(d),
    "op4": lambda d: quality.score_quality(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality"))),
    "op5": lambda d: langid.identify(d),
    "op6": lambda d: neardup.near_duplicates(d),
    "op7": lambda d: pii.find_pii(d),
    "op8": lambda d: bpe.encode_documents(d, queries.vocabulary_path()),
    "op9": lambda d: mixing.mix_sources(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, docs, name):
    got = OPERATORS[name](docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.asDict())
    equal = by[5]
    if name in ("op2", "op4", "op5", "op7", "op8"):
        drop = ("near_next", "near_edited", "edited_sha256", "edited_fingerprint")
        strip = lambda r: {k: v for k, v in r.items() if k not in drop}
        assert all(strip(r) == strip(equal[0]) for r in equal)
    empty = {"op1": ("size", 1), "op2": ("fingerprint", ""), "op3": ("n_words", 0), "op5": ("lang_pred", "und"), "op6": ("kept", True), "op7": ("spans", ""), "op8": ("n_tokens", 0), "op9": ("taken", 0)}
    if name in empty:
        column, want = empty[name]
        assert [by[i][0][column] for i in (100, 101)] == [want, want]
    long_ = {"op1": ("size", len(LONG) + 1), "op2": ("n_chars", len(LONG)), "op3": ("n_removed", 0), "op5": ("lang_pred", "aa"), "op6": ("class_id", 103), "op9": ("size", 60_000)}
    if name in long_:
        assert by[103][0][long_[name][0]] == long_[name][1]
    if name == "op1":
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(16))
    if name == "op2":
        assert by[103][0]["fingerprint"] == by[104][0]["fingerprint"]
    if name == "op3":
        assert by[104][0]["n_removed"] == 60_000 and all(r["n_removed"] == 0 for r in equal)
    if name == "op6":
        assert by[104][0]["class_id"] == 103 and not by[104][0]["kept"] and all(r["kept"] and r["n_equal"] == 4 for r in equal)
        assert {r["class_id"] for r in by[6]} == {6} and by[107][0]["class_id"] == 7
    if name == "op8":
        assert by[103][0]["decoded"] == LONG
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_unlike_texts_of_one_id_join_no_classes(spark):
    """Rows of equal id and different text are classed by their text."""
    a, b = make(1, 80), make(2, 80)
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(1, True), (1, True), (2, False), (3, False)]
    assert sorted((r.doc_id, r.text) for r in neardup.drop_near_duplicates(df).collect()) == sorted([(1, a), (1, b)])
    named = neardup.near_duplicates(df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))).where("not kept")
    assert sorted(r.doc_id for r in named.collect()) == ["d2", "d3"]


STAGE_ROWS = {  # ids that must stay or go, and how many rows there are (None: any)
    "language_id": ({103, 104, 5, 6, 107, None}, {100, 101, 102, 105}),
    "near_dedup": ({103, 5, 6, 100, 101, 105}, {104, 107}),
    "personal_data": ({r[0] for r in ROWS}, set()),
    "mix": (set(), {100, 101, 102}),
}


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, "").collect()
    ids = {r.doc_id for r in got}
    if name in STAGE_ROWS:
        stay, go = STAGE_ROWS[name]
        assert stay <= ids and not go & ids
        assert stage(spark, docs, "").columns == docs.columns
        assert all(r["a.b"] == len(INSIDE) - 1 and r._row == INSIDE.index("_row") for r in got)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    if name == "personal_data":
        assert len(got) == len(ROWS) and {r.text for r in got if r.doc_id == 108} == {"mail <EMAIL> or <PHONE>"} and all(r.text is None for r in got if r.doc_id == 100)
    if name == "near_dedup":
        assert sum(r.doc_id == 5 for r in got) == 4  # equal in id and text: nothing tells them apart
    if name == "language_id":
        assert {r.lang for r in got if r.doc_id == 107} == {"aa"} and sum(r.doc_id == 5 for r in got) == 4
    if name == "mix":
        size = sum(len((r[1] or "").split()) for r in ROWS)
        assert abs(sum(len(r.text.split()) for r in got) - 1.5 * size) <= 3 or all(len(r.text) for r in got)
    if name == "encode":
        assert len(got) == len(ROWS) and all(r.exact for r in got)
    assert stage(spark, docs.limit(0), "").count() == 0

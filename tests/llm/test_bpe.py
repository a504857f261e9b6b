"""op8 against the tokenizers library, and round trips."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe, queries

PATH = queries.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return t


def same(library, text):
    own = bpe.load(PATH)
    ids = np.frombuffer(own.encode(text), dtype="<u4").tolist()
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want, text[:200]
    assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    same(library, text)


def test_chosen_texts(library):
    rng = random.Random(0)
    bits = ["'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", " ", "　", "\x1c", "\x0b", "abc", "Ünï", "123", "½²", "Ⅷ", "٣", "漢字", "🙂", "é", "_", "!!", "<|endoftext|>", "<|endof", "​", "ß", "\0"]
    for _ in range(3000):
        same(library, "".join(rng.choice(bits) for _ in range(rng.randrange(12))))
    for long in ("a" * 50_000, "ab" * 20_000, " " * 5000, "é" * 20_000, "".join(rng.choice("etaoinshr") for _ in range(60_000))):
        same(library, long)


def test_query_against_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.queries()["op8_bpe"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as n_tokens")
    got = bpe.encode_documents(df, PATH).collect()
    assert [(r.doc_id, r.n_tokens, r.decoded) for r in got] == [(1, 0, ""), (2, 0, ""), (3, 2, "a b"), (3, 2, "a b"), (None, 1, "x")] and got[2].ids == [64, 275]
    assert bpe.encode_documents(df.limit(0), PATH, digest=True).count() == 0

"""The pipeline, stage by stage, on what the stage before kept."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_plain_versions(spark, sf_dir, tmp_path):
    from tests.llm.test_neardup import brute
    from tests.llm.test_pii import brute as base_spans

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if name != "encode":
            assert sorted(docs.columns) == sorted(columns)
        if name == "language_id":
            assert {r.doc_id for r in rows} == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
            assert all(r.text == before[r.doc_id].text for r in rows)
        elif name == "near_dedup":
            want = brute([(i, r.text) for i, r in before.items()])
            assert {r.doc_id for r in rows} == {i for i, c in want.items() if i == c} and len(rows) < len(before)
        elif name == "personal_data":
            assert {r.doc_id for r in rows} == set(before)
            for r in rows:
                assert not base_spans(r.text) and r.n_chars == len(r.text)
                if not base_spans(before[r.doc_id].text) and "=" not in before[r.doc_id].text:
                    assert r.text == before[r.doc_id].text
        elif name == "mix":
            size = {i: len(r.text.split()) for i, r in before.items()}
            taken = Counter()
            for r in rows:
                taken[r.doc_id] += len(r.text.split())
                assert r.text in before[r.doc_id].text  # a piece: documents are cut where the mix's blocks end
            assert all(n <= 2 * size[i] for i, n in taken.items())
            assert abs(sum(taken.values()) / sum(size.values()) - 1.5) < 0.01
            last = Counter(r.doc_id for r in rows)
        else:
            assert Counter(r.doc_id for r in rows) == last and all(r.exact and len(r.ids) == r.n_tokens for r in rows)
        if name not in ("mix", "encode"):
            before = {r.doc_id: r for r in rows}

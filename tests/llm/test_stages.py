"""Every stage of the pipeline on odd rows and on an empty table."""

import pytest

import corpus_pipeline
from tests.llm.test_jobs import odd_documents


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows_and_on_none(spark, small, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd_documents(spark)
    out = stage(spark, docs, small)
    rows = out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns and len(rows) <= docs.count()
    if name == "n-gram Jaccard join":
        assert [r["doc_id"] for r in rows if r["doc_id"] in (1, 2, 8)] == [1]
    if name == "suffix-array dedup":
        assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None) and "" not in [r["text"] for r in rows]
    if name == "best-fit packing":
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    assert stage(spark, docs.filter("false"), small).count() == 0

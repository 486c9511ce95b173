"""The pipeline's stages on a small table."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tidemill.llm import decontaminate, langid, neardup, quality  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_keep_what_their_operators_keep(spark):
    docs = corpus_pipeline.table(spark, DATA, "documents")
    labels = corpus_pipeline.table(spark, DATA, "labels")
    items = corpus_pipeline.table(spark, DATA, "benchmark")
    for (_, stage), keep in zip(
        corpus_pipeline.STAGES[:-1],
        (
            lambda d: quality.classify(d, labels).filter("predicted = 1"),
            lambda d: langid.identify(d).filter(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_LANGUAGE_SCORE}"),
            lambda d: neardup.near_duplicates(d).filter("kept"),
            lambda d: decontaminate.find(d, items).filter("not contaminated"),
        ),
    ):
        out = corpus_pipeline.saved(stage(spark, docs, DATA))
        assert out.columns == docs.columns
        assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in keep(docs).select("doc_id").collect())
        assert out.exceptAll(docs).count() == 0
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert sorted(r[0] for r in pieces.select("doc_id").distinct().collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
    whole = pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r[1] == r[2] for r in whole)


def test_odd_and_empty_documents(spark):
    docs = corpus_pipeline.table(spark, DATA, "documents")
    extra = spark.createDataFrame([(None, None, None, None, None), (99001, "", None, "s", 0), (99002, None, "en", None, 0), (99003, "plain words", "en", "s", 11), (99003, "plain words", "en", "s", 11)], docs.schema)
    for table in (docs.unionByName(extra), docs.limit(0)):
        at = table
        for _, stage in corpus_pipeline.STAGES:
            at = corpus_pipeline.saved(stage(spark, at, DATA))
    assert at.count() == 0

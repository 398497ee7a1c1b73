"""BM25 over texts in mixed languages: no document is left out of the index, against brute force."""

import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millrace.functions import exprs
from millrace.plans import catalog_search

DOCS = [(1, "hash joins are fast"), (2, "向量索引 uses hash joins"), (3, "annex of the report"), (4, "向量索引很快"), (5, "ひらがな annex annex")]


def test_all_documents_are_indexed(spark):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    items = spark.createDataFrame([("q", "向量索引")], "item_id string, item_text string")
    t = SimpleNamespace(spark=spark, documents=df, eval_items=items)
    words = {r.doc_id: r.w for r in df.select("doc_id", exprs.terms(F.col("text")).alias("w")).collect()}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for term in ("hash", "joins", "annex", "向量", "量索", "索引"):
        n = sum(term in w for w in words.values())
        for k, w in words.items():
            if tf := w.count(term):
                want[k] = want.get(k, 0) + math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    assert {r.doc_id: r.score for r in catalog_search.fts_bm25_scores(t).collect()} == pytest.approx({k: round(x, 6) for k, x in want.items()})
    assert {r.doc_id for r in catalog_search.fts_top(t).collect()} == {1, 2, 3, 4, 5}
    assert {r.doc_id for r in catalog_search.batch_retrieval(t).collect()} == {2, 4}

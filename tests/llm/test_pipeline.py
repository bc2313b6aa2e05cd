"""The pipeline over a small table, stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import PASSAGE, ROWS
from tests.util import same_rows


def test_stages_take_effect(spark, odd):
    odd = odd.withColumns({c: F.lit("x") for c in ("keep_id_", "text_sha256", "box", "lang_pred", "lettered", "doc", "spans", "order", "__key", "__language", "found", "row")})
    docs = odd
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd.columns, name
        docs = docs.cache()
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in odd.schema] and all(tuple(r[4:]) == ("x",) * (len(r) - 4) for r in docs.collect()), name
        seen.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.select("doc_id").collect()))
    ids = [[None if none else k for none, k in s] for s in seen]
    assert set(ids[0]) == {k for k, *_ in ROWS} - {3, 4, 5, 12}
    assert ids[1].count(8) == 1 and 9 not in ids[1] and 1 not in ids[1] and 2 in ids[1]
    assert 6 in ids[2] and 7 not in ids[2]
    assert {r["doc_id"]: r["text"] for r in docs.collect()}[11] == "other words" and PASSAGE in {r["doc_id"]: r["text"] for r in docs.collect()}[10]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]


def test_nothing(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_sql(spark, sf_dir, duck):
    for name, sql in ORACLES.items():
        same_rows(QUERIES[name](spark, sf_dir), duck, sql)

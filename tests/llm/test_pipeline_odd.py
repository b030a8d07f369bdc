"""The pipeline's stages over odd rows: nulls, repeats, empty texts and tables, columns of other names."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_odd_rows(spark):
    known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(30).collect()
    text = max((r.text for r in known), key=len)
    rows = [tuple(r) for r in known] + [(9001, None, None, None, None), (9002, "", "en", "a", 0), (9003, "123 456", "en", "a", 7), (None, text, None, None, None), (9004, text, "en", "a", 1), (9004, text, "en", "a", 1), (9005, text + " more", "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("_gone", "gone", "digest", "score", "salt", "n", "lang_pred")})
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, docs, "").cache()
    assert one.columns == docs.columns and not {9001, 9002, 9003} & {r.doc_id for r in one.collect()} and one.filter("doc_id IN (9004, 9005)").count() == 3
    two = stages[1](spark, one, "").cache()
    assert two.columns == docs.columns and two.filter("doc_id = 9004").count() == 1 and two.filter("doc_id IS NULL").count() == 0
    three = stages[2](spark, two, "").cache()
    smallest = min(r.doc_id for r in known if r.text == text)
    left = {r.doc_id for r in three.collect()}
    assert three.columns == docs.columns and not left & {9004, 9005} - {smallest} or smallest not in {r.doc_id for r in two.collect()}
    packed = stages[3](spark, three, "").collect()
    assert {r.doc_id for r in packed} == left
    windows = {}
    for r in packed:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        ends = [sum(p) for p in sorted(pieces)]
        assert [p[0] for p in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0

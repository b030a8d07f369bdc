"""Columns whose names are those that the operators use themselves stay as they are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keyhold.llm import embedding_dedup, exact_dedup, html_text, line_dedup, ngram_join, packing, url_filter

NAMES = ["_url", "_found", "url_", "found", "_html", "source", "_shared", "_other", "_id", "_key", "_gone", "gone", "_salt", "_rank", "_at", "place", "salt", "rank", "kept_id", "sha", "copies", "digest", "shared", "lost", "mark", "_content", "_sha", "count", "_n", "_k0", "n", "k0", "exact", "cluster", "least"]
TEXT = "one two three four five six seven eight nine ten"
CASES = {
    "judge": (lambda df: url_filter.judge(df, [("block", "com", "/")]), [("http://a.com/x", 1), ("http://b.org", 2)], "url string, id long", 2),
    "extract": (html_text.extract, [("<p>a</p>", "http://a.com", 1)], "html string, url string, page_id long", 1),
    "dedup_lines": (line_dedup.dedup_lines, [(1, TEXT * 20), (2, TEXT * 20)], "doc_id long, text string", 2),
    "exact keep_one": (exact_dedup.keep_one, [(1, TEXT), (2, TEXT)], "doc_id long, text string", 1),
    "near keep_one": (ngram_join.keep_one, [(1, TEXT), (2, TEXT), (3, "other words")], "doc_id long, text string", 2),
    "near keep_one, ids repeat": (ngram_join.keep_one, [(1, TEXT), (1, TEXT), (3, "other words"), (3, "yet other words")], "doc_id long, text string", 3),
    "vectors keep_one": (embedding_dedup.keep_one, [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>", 3),
    "pack": (packing.pack, [(1, 0, 7), (2, 0, 9)], "doc_id long, start long, length long", 2),
}


@pytest.mark.parametrize("case", CASES)
def test_names_that_clash(spark, case):
    f, rows, schema, count = CASES[case]
    df = spark.createDataFrame(rows, schema)
    extra = [c for c in NAMES if c not in df.columns]
    got = f(df.withColumns({c: F.lit(f"own {c}") for c in extra})).collect()
    assert len(got) == count and all(r[c] == f"own {c}" for r in got for c in extra)


def test_vectors_keep_one(spark):
    """Nulls, repeated and zero vectors: what links with nothing stays, and of a component the smallest id."""
    rows = [(5, [1.0, 0.0]), (4, [2.0, 0.0]), (7, [0.0, 0.0]), (8, None), (9, [None, 1.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(str, (r.vec_id for r in embedding_dedup.keep_one(df).collect()))) == ["3", "3", "4", "7", "8", "9", "None"]
    assert embedding_dedup.keep_one(df.limit(0)).count() == 0

from __future__ import annotations

import hashlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from keyhold.llm import queries, word_pieces

MODEL = queries.PIECE_MODEL
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  "), (5, "a "), (6, " a  b\n\nc "), (7, "▁x▁▁ y"), (8, "\x00 a\x00"), (9, "日本語 テスト 🤦🏼‍♂️"),
    (10, "x" * 50_000 + " " + "y " * 20_000), (None, "null id"), (5, "a "), (11, "\t\r\n"), (12, "<s> </s> <unk>"),
]


def test_whole_table(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in queries.op13_word_pieces(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = sp.encode(r.text or "", add_eos=True)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_odd_texts_and_columns(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit(c) for c in ("kept", "slice", "whole", "word", "ids", "a.b")})
    rows = word_pieces.encoded(docs, MODEL)
    assert set(rows.columns) == {"doc_id", "text", "kept", "slice", "whole", "word", "ids", "a.b"}
    rows = rows.collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in rows))) == sorted(map(str, ODD))
    for r in rows:
        assert r.ids == sp.encode(r.text or "", add_eos=True) and (r.kept, r.slice, r["a.b"]) == ("kept", "slice", "a.b")
    bare = {r.text: r.ids for r in word_pieces.encoded(docs, MODEL, end=False, keep=["text"]).collect()}
    assert bare[""] == [] and bare["a "] == sp.encode("a ")
    back = word_pieces.decoded(word_pieces.encoded(docs, MODEL).withColumnRenamed("text", "was"), MODEL).collect()
    assert all(r.text == sp.decode(sp.encode(r.was or "")) for r in back)


def test_decode_odd_ids(spark):
    got = word_pieces.decoded(spark.createDataFrame([(1, None), (2, []), (3, [None, -1, 99_999_999, 259, 2])], "n int, ids array<long>"), MODEL).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [(r.n, r.text) for r in got] == [(1, ""), (2, ""), (3, sp.decode([259, 2]))]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert word_pieces.encoded(none, MODEL).count() == 0 and word_pieces.round_trip(none, MODEL).count() == 0


def test_answers_to_other_words():
    """Were rows in another order when read again, what doesn't answer a slice's own words is segmented there."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    of = word_pieces.Slice(MODEL, 3)
    of.add(["one two  two", ""], None)
    of.answer(1, b"x" * 16, np.array([1]), np.array([5]))
    assert [x.tolist() for x in of.ids()] == [sp.encode("one two  two"), []]


def test_refuses_pieces_across_markers(tmp_path, monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "a▁b")
    word_pieces.processor.cache_clear()
    with pytest.raises(ValueError, match="cross"):
        word_pieces.processor(MODEL)
    word_pieces.processor.cache_clear()

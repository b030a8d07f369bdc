"""A corpus from documents to training windows: language, exact copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyhold.llm import exact_dedup, language_id, ngram_join, packing
from keyhold.llm.queries import PACK_END, WORD_TOKENIZER
from keyhold.llm.shared import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the others go: a null or empty text, or one without letters, too. Rows that repeat are
    judged alike. An empty table gives no rows."""
    return language_id.keep_known(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id; null counts as empty, and a null id loses to any other. Of rows that
    repeat both, one. An empty table gives no rows."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the one with the smallest doc_id. Texts without words, and rows without an id, link with
    nothing and stay; rows that repeat an id are told apart by their texts. An empty table gives no rows."""
    return ngram_join.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and where each lies in the training windows. A null text is its end id alone; null and
    repeated ids stay as they are. An empty table gives no rows."""
    return packing.pack_documents(docs, WORD_TOKENIZER, PACK_END)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("packing", packed),
]

#: Profiles and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before it kept; odd rows as in the stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

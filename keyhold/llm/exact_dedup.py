"""Exact dedup by skew-safe combining.

Copies are first combined within each input task, then within salted digest groups, then the salts' winners across
salts. A digest has several salts where its rows could fill a task, and else one, so that only texts of the former move twice.
Digest and whole text are both grouping keys at every stage, so texts are equal only when all their content is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyhold.llm.shared import HOT_SHARE, Scratch, free, written

SALTS = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, normalize: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``; the largest id of equal texts stays.

    normalize: an expression over the columns of ``docs`` to compare in the text's place. A null text counts as empty.
    Rows that repeat both text and id stay or go together. A null id loses to any other; where all ids of a group are
    null, keep_id is null and all stay. Other columns are not looked at. An empty table gives no rows.
    """
    text = F.col(f"`{text_col}`") if normalize is None else normalize
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("content"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.encode("content", "utf-8"), 256)))
    several = written(rows.groupBy("digest").count().filter(F.col("count") > max(1, docs.count() // HOT_SHARE)).select("digest", F.lit(salts).alias("salts")), "salts")
    salt = F.when(F.col("salts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    # each groupBy below combines in the map task first: a group of copies leaves a task as one row a salt
    salted = rows.join(F.broadcast(several), "digest", "left").groupBy("digest", "content", salt.alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    across = salted.filter("salt > 0").groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = salted.filter("salt = 0").drop("salt").unionByName(across)
    by_digest = written(groups.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("texts")), "digests")
    out = _attach(rows.select("doc_id", "digest"), by_digest.filter("texts = 1").drop("texts"))
    if not by_digest.filter("texts > 1").isEmpty():  # different texts with one digest: told apart by their content
        clash = F.broadcast(by_digest.filter("texts > 1").select("digest"))
        own = groups.join(clash, "digest", "left_semi")
        out = out.unionByName(rows.join(own, ["digest", "content"]).select("doc_id", "digest", "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _attach(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Give each row its group; a large group's rows don't move."""
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.filter(F.col("group_size") > max(1, total // HOT_SHARE))
    near = rows.join(F.broadcast(hot.withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"})), "digest", "left")
    cold = groups.filter(F.col("group_size") <= max(1, total // HOT_SHARE)).withColumnRenamed("digest", "_digest")
    # rows of large groups are dealt out by a key of their own, which matches nothing
    own = F.unhex(F.sha2(F.concat_ws(":", F.lit("placed"), F.col("doc_id").cast("string")), 224))
    key = F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(own)
    out = near.withColumn("_key", key).join(cold, F.col("_key") == F.col("_digest"), "left").filter("hot_size IS NOT NULL OR group_size IS NOT NULL")
    return out.select("doc_id", "digest", F.coalesce("hot_id", "keep_id").alias("keep_id"), F.coalesce("hot_size", "group_size").alias("group_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each text exactly one row, one with its largest doc_id.

    A null text counts as empty. A null doc_id loses to any other. Of rows that repeat both the text and its largest
    doc_id (or where all are null), one stays. An empty table gives no rows.
    """
    at, sha, count, digest, rank = (free(docs, c) for c in ("kept_id", "sha", "copies", "digest", "rank"))
    with Scratch(docs.sparkSession) as scratch:
        marked = scratch.keep(exact_dedup(docs).filter("kept").groupBy(F.col("doc_id").alias(at), F.col("text_sha256").alias(sha)).agg(F.count("*").alias(count)), "kept")
    content = F.coalesce("text", F.lit(""))
    rows = docs.withColumn(digest, F.sha2(F.encode(content, "utf-8"), 256))
    stay = rows.join(marked, F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(digest) == F.col(sha)))
    single, repeated = stay.filter(F.col(count) == 1).select(docs.columns), stay.filter(F.col(count) > 1)
    if marked.filter(F.col(count) > 1).isEmpty():
        return single
    order = Window.partitionBy(digest, content, "doc_id").orderBy(F.lit(1))
    return single.unionByName(repeated.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= 1).select(docs.columns))

"""The sketch of held keys, and the newest rows taken by pieces."""

from __future__ import annotations

import re
import sys

import pytest
from pyspark.sql import functions as F

from keyhold import WindowConfig
from keyhold import operators as ops
from keyhold.operators import sketch
from tests.test_window import SCHEMA

snapshot = sys.modules["keyhold.operators.snapshot"]  # its function of that name hides it
HELD = "key string, anchor long, tie long"


def held_keys(spark, n, step=7):
    return spark.range(n).select(F.concat(F.lit("k"), F.col("id") * step).alias("key"), (F.col("id") * 3 - 50).alias("anchor"), F.col("id").alias("tie"))


def flags(df, column="key"):
    return sorted((r[column] or "", r.seen) for r in df.collect())


@pytest.mark.parametrize("room", [0, 3, 40])
def test_same_rows(spark, room):
    """However little room the filter has: the rows of the plain joins; null, empty and repeated keys among them."""
    held = held_keys(spark, 40).unionByName(spark.createDataFrame([("", -9, 1), ("ä", 0, 2), (None, 5, 3), ("ä", 4, 4)], HELD))
    keys = [f"k{i}" for i in range(60)] + ["", "ä", None, "k7", "k7"]
    probe = spark.createDataFrame([(k, i, i) for i, k in enumerate(keys)], "key string, block long, `w0` long").withColumn("_held", F.lit(1))
    s = sketch.KeySketch.of(held, room, 10)
    plain = ops.flag_seen(probe, held)
    got = ops.flag_seen_pruned(probe, held, s)
    assert got.columns == plain.columns == [*probe.columns, "seen"]
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert sum(seen for _, seen in flags(got)) == len([k for k in keys if k in {f"k{7 * i}" for i in range(40)} | {"", "ä"}])
    for pruned, whole in ((ops.seen_only_pruned, ops.seen_only), (ops.unseen_only_pruned, ops.unseen_only)):
        assert sorted(map(str, pruned(probe, held, s).collect())) == sorted(map(str, whole(probe, held).collect()))
    none = held.limit(0)
    assert not any(seen for _, seen in flags(ops.flag_seen_pruned(probe, none, sketch.KeySketch.of(none, room, 10))))
    assert ops.flag_seen_pruned(probe.limit(0), held, s).count() == 0


def test_share_pruned(spark):
    """Of keys that aren't held, nearly all stop before the shuffle; of those that are, none."""
    held, probe = held_keys(spark, 20_000, 1), spark.range(100_000).select(F.concat(F.lit("k"), "id").alias("key"))
    s = sketch.KeySketch.of(held, 20_000, 1000)
    passed = s.marked(probe, "key", "maybe").filter("maybe").agg(F.count("*"), F.count_if(F.substr("key", F.lit(2)).cast("long") < 20_000)).first()
    assert passed[1] == 20_000 and passed[0] - 20_000 < 0.01 * 80_000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = ops.seen_only_pruned(probe, held, s)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the probe's exchange lies above the filter's broadcast join
    assert re.search(r"(?s)SortMergeJoin.*LeftSemi.*Exchange hashpartitioning\(key.*BroadcastHashJoin", plan), plan


def test_merge_and_age(spark):
    one, two = (sketch.KeySketch.of(h, 40, 10) for h in (held_keys(spark, 20), held_keys(spark, 40).filter("tie >= 20")))
    whole = sketch.KeySketch.of(held_keys(spark, 40), 40, 10)
    rows = lambda s: sorted(tuple(r) for r in s.rows.collect())
    assert rows(one.merged(two)) == rows(two.merged(one)) == rows(whole) == rows(whole.merged(one))
    with pytest.raises(ValueError):
        one.merged(sketch.KeySketch.of(held_keys(spark, 9), 40, 11))
    now, span = 40, 30
    probe = held_keys(spark, 40).withColumn("old", now - F.col("anchor") > span)
    marked = whole.fresh(now, span).marked(probe, "key", "maybe").collect()
    assert all(r.maybe for r in marked if not r.old) and not all(r.maybe for r in marked)
    assert {r.bucket for r in whole.fresh(now, span).rows.collect()} == {b for b in range(-5, 7) if b * 10 + 9 >= now - span}
    assert whole.fresh(now, None) is whole


def test_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BROADCAST_BYTES", 0)
    held, probe = held_keys(spark, 10), held_keys(spark, 20).select("key")
    s = sketch.KeySketch.of(held, 10, 10)
    got = ops.flag_seen_pruned(probe, held, s)
    assert not s.broadcasts and flags(got) == flags(ops.flag_seen(probe, held))


@pytest.mark.parametrize("most", [1, 17, 59, 60, 90])
def test_newest_by_pieces(spark, monkeypatch, most):
    """Ties in time, repeated rows, and more room than rows."""
    rows = [(f"k{i}", i * i % 11, i) for i in range(59)] + [("k5", 3, 5)]
    held = spark.createDataFrame(rows, HELD).repartition(5)
    want = sorted(((a, t, k) for k, a, t in rows), reverse=True)[:most]
    for take in (100, 0):
        monkeypatch.setattr(snapshot, "TAKE_ROWS", take)
        got = sorted(((r.anchor, r.tie, r.key) for r in snapshot.newest(held, most).collect()), reverse=True)
        assert got == want and snapshot.newest(held.limit(0), most).count() == 0
    c = WindowConfig(None, 3, "last")
    seen = spark.createDataFrame(rows, SCHEMA)
    assert [r.key for r in ops.retained_keys(ops.snapshot(seen, c)).collect()] == [k for _, _, k in reversed(sorted(set(((a, t, k) for k, a, t in rows)), reverse=True)[:3])]

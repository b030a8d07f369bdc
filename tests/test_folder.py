"""Window folders as a data source."""

from __future__ import annotations

import glob
import os

import pytest

from keyhold import WindowConfig
from keyhold.plans import KeyWindow
from keyhold.sources import StaleWindowError, folder
from tests.test_window import SCHEMA

HELD = "key string, anchor long, tie long"
ROWS = [("a", 5, 1), ("", -3, 2), ("ä", 9, 3), ("b" * 5000, 7, -4)]


@pytest.fixture(autouse=True)
def registered(spark):
    folder.register(spark)


def put(df, path, **options):
    df.write.format(folder.NAME).mode("overwrite").options(**options).save(path)


def get(spark, path, **options):
    return spark.read.format(folder.NAME).options(**options).load(path)


def test_read_what_was_saved(spark, tmp_path):
    path = str(tmp_path / "w")
    w = KeyWindow.open(spark, path, WindowConfig(10))
    w.save(path)
    assert get(spark, path).count() == 0 and get(spark, f"file:{path}").columns == ["key", "anchor", "tie"]
    w.observe(spark.createDataFrame([("a", 1, 1), ("b", 5, 2), ("a", 6, 3)], SCHEMA), "key", "t", "tie")
    w.save(path)
    w.observe(spark.createDataFrame([("c", 13, 4)], SCHEMA), "key", "t", "tie")
    w.save(path)
    assert sorted(map(tuple, get(spark, path).collect())) == [("b", 5, 2), ("c", 13, 4)]
    assert sorted(map(tuple, get(spark, path, version=2).collect())) == [("a", 1, 1), ("b", 5, 2)]
    for push in (False, True):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", push)
        try:
            assert [r.key for r in get(spark, path, push_filters=push).filter("key = 'c' AND anchor > 5").collect()] == ["c"]
            assert get(spark, path, push_filters=push).filter("anchor <= 5 AND key < 'b'").count() == 0
        finally:
            spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert [r.key for r in get(spark, path).filter("length(key) = 1").orderBy("anchor").select("key").collect()] == ["b", "c"]
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW held USING {folder.NAME} OPTIONS (path '{path}')")
    assert [r.key for r in spark.sql("SELECT key FROM held ORDER BY anchor DESC").collect()] == ["c", "b"]
    with pytest.raises(Exception, match="no version 9"):
        get(spark, path, version=9).collect()
    with pytest.raises(Exception, match="no saved window"):
        get(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize("ties", [HELD, "key string, anchor long, tie string"])
def test_load_what_was_written(spark, tmp_path, ties):
    """The checksum that the writer makes is the one that load checks; empty tasks leave no file."""
    path = str(tmp_path / "w")
    rows = [(k, a, t if ties == HELD else f"tie {t}") for k, a, t in ROWS]
    df = spark.createDataFrame(rows, ties).repartition(9)
    put(df, path, span_us=10, capacity=7, policy="last", clock=12, admitted=9, expired=3, evicted=2)
    w = KeyWindow.open(spark, path)
    assert (w.config, w.clock, w.versions) == (WindowConfig(10, 7, "last"), 12, {path: 1})
    assert tuple(w.stats(spark).first()) == (10, 7, 4, 9, 3, 2, 0)
    assert sorted(map(tuple, w.held.collect())) == sorted(rows) == sorted(map(tuple, get(spark, path).collect()))
    assert w.save(path) == 2
    put(df.limit(0), path, version=2)
    assert KeyWindow.open(spark, path).keys().count() == 0 and get(spark, path).count() == 0
    put(df.limit(2).selectExpr("tie", "anchor", "key"), path)
    assert tuple(KeyWindow.open(spark, path).stats(spark).first())[2:5] == (2, 2, 0)
    os.remove(glob.glob(f"{path}/contents/version=4-*/*.parquet")[0])
    with pytest.raises(Exception, match="damaged"):
        get(spark, path).collect()


def test_one_of_two_writers(spark, tmp_path):
    path = str(tmp_path / "w")
    df = spark.createDataFrame(ROWS, HELD)
    put(df, path)
    w = KeyWindow.open(spark, path)
    put(df.limit(1), path, version=1)
    with pytest.raises(StaleWindowError):
        w.save(path)
    with pytest.raises(Exception, match="follows version 1"):
        put(df, path, version=1)
    # both planned on version 2; the second finds another at its commit
    schema = df.schema
    one, two = (folder._Writer({"path": path}, schema) for _ in range(2))
    batch = lambda: iter(df.toArrow().to_batches())
    done = [(x, x.write(batch()), x.write(batch())) for x in (one, two)]
    one.commit([done[0][1]])  # the other attempt's file never counts
    with pytest.raises(StaleWindowError):
        two.commit([done[1][1]])
    assert get(spark, path).count() == KeyWindow.open(spark, path).keys().count() == 4
    assert len(glob.glob(f"{path}/contents/*")) == 3
    files, at = folder._opened(path)
    assert not folder._created(files, f"{at}/manifest/v3.json", b"{}") and KeyWindow.open(spark, path).versions == {path: 3}


def test_refused(spark, tmp_path):
    path = str(tmp_path / "w")
    df = spark.createDataFrame(ROWS, HELD)
    with pytest.raises(Exception, match="overwrite"):
        df.write.format(folder.NAME).mode("append").save(path)
    with pytest.raises(Exception, match="rows must be"):
        put(df.selectExpr("key", "anchor"), path)
    with pytest.raises(Exception, match="must not be null"):
        put(df.unionByName(spark.createDataFrame([(None, 1, 1)], HELD)), path)
    assert glob.glob(f"{path}/manifest/v*") == [] and glob.glob(f"{path}/contents/*") == []
    with pytest.raises(Exception, match="span_us"):
        put(df, path, span_us=-1)

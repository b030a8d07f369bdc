"""The window over streams against the batch window and a plain simulator."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from keyhold import WindowConfig
from keyhold import operators as ops
from keyhold.streaming import admit_stream, observe, stream_held, stream_stats
from tests.test_window import SCHEMA, simulate

SECOND = 1_000_000
STREAM = "key string, ts timestamp, tie long"


class Run:
    """A stream over files that are put into a folder one by one; it stops after each call and starts again from its checkpoint."""

    def __init__(self, spark, folder, config, delay):
        self.spark, self.folder, self.config, self.delay, self.n = spark, folder, config, delay, 0

    def put(self, rows):
        df = self.spark.createDataFrame(rows, SCHEMA).select("key", F.timestamp_micros("t").alias("ts"), "tie")
        df.coalesce(1).write.parquet(str(self.folder / f"in{self.n}"))
        self.n += 1

    def go(self):
        source = self.spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in*"))
        sink = admit_stream(source, self.config, self.delay).writeStream.format("parquet").option("path", str(self.folder / "out"))
        sink.option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start().awaitTermination(120)

    @property
    def checkpoint(self):
        return str(self.folder / "cp")

    def rows(self):
        return self.spark.read.parquet(str(self.folder / "out")).collect()


@pytest.mark.parametrize("config,parts", [(WindowConfig(40 * SECOND), 1), (WindowConfig(40 * SECOND), 3), (WindowConfig(60 * SECOND, 2, "last"), 2), (WindowConfig(60 * SECOND, 2, "refuse"), 3)])
@pytest.mark.parametrize("few", [256, 3])
def test_stream_equals_batch(spark, tmp_path, monkeypatch, config, parts, few):
    """However the rows are cut into batches, and over a stop; and so is what is read back from its state."""
    monkeypatch.setattr(observe, "FEW", few)
    rows = [("abc"[i * 7 % 3], 10**9 + i * 9 * SECOND, i) for i in range(24)]
    run = Run(spark, tmp_path, config, "10 minutes")
    for n in range(parts):  # out of order over the batches
        run.put([r for r in rows if r[2] % parts == n] + [(None, 10**9, 500 + n)])
    run.go()
    run.put([("z", 10**11, 99)])
    run.go()
    want, held = simulate(rows, config)
    assert {r.tie: (r.admitted, r.late) for r in run.rows()} == {i: (a, False) for i, a in want.items()}
    batch = spark.createDataFrame(rows, SCHEMA)
    assert tuple(stream_stats(spark, run.checkpoint, config).first()) == tuple(ops.stats(batch, config).first())
    kept = stream_held(spark, run.checkpoint, config)
    assert sorted(r.key for r in ops.retained_keys(kept).collect()) == sorted(r.key for r in ops.snapshot(batch, config).collect())
    probe = spark.createDataFrame([("a",), ("q",), (None,)], "key string")
    assert {r.key: r.seen for r in ops.flag_seen(probe, kept).collect()} == {r.key: r.seen for r in ops.flag_seen(probe, ops.snapshot(batch, config)).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_late_rows_come_back(spark, tmp_path, seed):
    """admitted + repeats + late = rows in; what isn't late is marked as if the rest had never come."""
    rng = random.Random(seed)
    config, run = WindowConfig(64 * SECOND), Run(spark, tmp_path, WindowConfig(64 * SECOND), "0 seconds")
    rows = [(rng.choice("ab"), 10**9 + rng.randrange(600) * SECOND, i) for i in range(60)]
    for n in range(3):
        run.put(rows[20 * n : 20 * n + 20])
    run.put([("z", 10**11, 999)])
    run.go()
    got = {r.tie: (r.admitted, r.late) for r in run.rows() if r.tie != 999}
    on_time = [r for r in rows if not got[r[2]][1]]
    assert got.keys() == {i for *_, i in rows} and 0 < len(on_time) < len(rows)
    want, _ = simulate(on_time, config)
    assert {i: (a, False) for i, a in want.items()} == {i: x for i, x in got.items() if not x[1]}
    assert all(a is None for a, late in got.values() if late)
    # late: its bucket lay before what an earlier batch had reached
    reached = 0
    for n in range(3):
        part = rows[20 * n : 20 * n + 20]
        assert all(got[i][1] == ((t // SECOND + 1) * SECOND <= reached) for _, t, i in part)
        reached = max([reached, *(t for _, t, _ in part)])
    s = stream_stats(spark, run.checkpoint, config).first()
    assert s.admitted + s.repeats == len(on_time) and s.admitted == s.retained + s.expired + s.evicted


def test_empty_stream(spark, tmp_path):
    run = Run(spark, tmp_path, WindowConfig(SECOND), "0 seconds")
    run.put([])
    run.put([(None, 5, 1)])
    run.go()
    assert not (tmp_path / "out").exists() or run.rows() == []

"""observe over a stream, with sightings put in order first.

Sightings wait in state, by time bucket, until the watermark has passed the end of their bucket, and are then handled in
order of (time, tie), so the result doesn't depend on how the stream was cut into batches. What a batch brings for a bucket
is written once and read once. A sighting whose bucket the watermark has passed already comes late: it is handed back as
such, and changes nothing; so every row of the stream comes out, with a mark or as late, or still waits.

A group has one timer, for the bucket that ends first; when it fires, all buckets that the watermark has passed are handled. A
group of few waiting sightings keeps them in one value. The first watermark is 1970, so sightings of then or before come late.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from keyhold.config import WindowConfig
from keyhold.operators.snapshot import described, fresh

OUT = "key string, t long, tie long, admitted boolean, late boolean"
BUCKETS = 64  # in a span
FEW = 256  # sightings that wait in one value
BUCKET_US = 60_000_000  # of a window without a span
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def bucket_us(config: WindowConfig) -> int:
    """Length of a bucket: whole milliseconds, as timers have them."""
    return BUCKET_US if config.span_us is None else max(1, config.span_us // BUCKETS // 1000) * 1000


class _Observe(StatefulProcessor):
    """One group: a key, or all keys if there is a capacity. Times are epoch microseconds."""

    def __init__(self, config: WindowConfig) -> None:
        self.config, self.width, self.few = config, bucket_us(config), FEW

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # some sightings wait here; when they are more, in parts by bucket, of which this tells how many there are
        self.index = handle.getValueState("index", "few string, parts string, timer long")
        self.waiting = handle.getMapState("waiting", "bucket long, part long", "rows string")
        self.held = handle.getMapState("held", "key string", "anchor long, place long")  # place: the order of anchors
        self.counts = handle.getValueState("counts", "admitted long, repeats long, late long, evicted long, clock long, place long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        passed, new, late = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for r in rows:
            if self._end(r.t) <= passed:
                late.append(Row(key=r.key, t=r.t, tie=r.tie, admitted=None, late=True))
            else:
                new.append((r.t, r.tie, r.key))
        if new:
            few, parts, timer = self._indexed()
            few += new
            if len(few) > self.few:
                by = defaultdict(list)
                for r in few:
                    by[r[0] // self.width].append(r)
                for bucket, some in by.items():
                    parts[bucket] = parts.get(bucket, 0) + 1
                    self.waiting.updateValue((bucket, parts[bucket]), (json.dumps(some),))
                few = []
            self._keep(few, parts, timer)
        if late:
            c = self._counted()
            self.counts.update((*c[:2], c[2] + len(late), *c[3:]))
        return iter(late)

    def _end(self, t: int) -> int:
        return (t // self.width + 1) * self.width

    def _indexed(self) -> tuple[list[tuple], dict[int, int], int]:
        few, parts, timer = self.index.get() if self.index.exists() else ("[]", "{}", 0)
        return [tuple(r) for r in json.loads(few)], {int(k): n for k, n in json.loads(parts).items()}, timer

    def _keep(self, few: list[tuple], parts: dict[int, int], timer: int) -> None:
        """What waits, with one timer for the bucket that ends first; timer: the one that is set, 0 for none."""
        ends = [self._end(r[0]) for r in few] + [(b + 1) * self.width for b in parts]
        wanted = min(ends) // 1000 if ends else 0
        if wanted != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if wanted:
                self.handle.registerTimer(wanted)
        if ends:
            self.index.update((json.dumps(few), json.dumps(parts), wanted))
        elif self.index.exists():
            self.index.clear()

    def _counted(self) -> tuple[int, ...]:
        return tuple(self.counts.get()) if self.counts.exists() else (0, 0, 0, 0, 0, 0)

    def _ready(self, upto: int) -> list[tuple[int, int, str]]:
        """The sightings of the buckets that end by then, in order; they no longer wait."""
        few, parts, timer = self._indexed()
        out = [r for r in few if self._end(r[0]) <= upto]
        for bucket in [b for b in parts if (b + 1) * self.width <= upto]:
            for part in range(1, parts.pop(bucket) + 1):
                out += map(tuple, json.loads(self.waiting.getValue((bucket, part))[0]))
                self.waiting.removeKey((bucket, part))
        self._keep([r for r in few if self._end(r[0]) > upto], parts, timer)
        return sorted(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        ready = self._ready(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000)
        if not ready:
            return iter([])
        c, out = self.config, []
        admitted, repeats, late, evicted, clock, place = self._counted()
        saved = sorted(((k[0], *v) for k, v in self.held.iterator()), key=lambda r: r[2])
        held = {k: (t, p) for k, t, p in saved}  # oldest first
        before = dict(held)
        for t, tie, k in ready:
            while c.span_us is not None and held and t - next(iter(held.values()))[0] > c.span_us:
                held.pop(next(iter(held)))
            new, place = k not in held, place + 1
            if not new and c.policy == "last":
                held.pop(k)
                held[k] = t, place
            elif new and c.capacity is not None and len(held) >= c.capacity and c.policy == "refuse":
                new = False
            elif new:
                if c.capacity is not None and len(held) >= c.capacity:
                    held.pop(next(iter(held)))
                    evicted += 1
                held[k] = t, place
            admitted, repeats, clock = admitted + new, repeats + (not new), max(clock, t)
            out.append(Row(key=k, t=t, tie=tie, admitted=new, late=False))
        for k in before.keys() - held.keys():
            self.held.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.held.updateValue((k,), v)
        self.counts.update((admitted, repeats, late, evicted, clock, place))
        return iter(out)

    def close(self) -> None:
        pass


def admit_stream(stream: DataFrame, config: WindowConfig, delay: str = "0 seconds") -> DataFrame:
    """Mark a stream (key, ts timestamp, tie long); needs the RocksDB state store. Returns key, t, tie, admitted, late.

    delay: how late a row may be. Rows with a null key, time or tie are left out. ``admitted`` is null for late rows. With a
    capacity all rows meet in one group, as each admission may depend on all earlier ones.
    """
    group = F.col("key") if config.capacity is None else F.lit("all")
    rows = stream.filter("key IS NOT NULL AND ts IS NOT NULL AND tie IS NOT NULL").withWatermark("ts", delay)
    # without the watermark's own column, Spark leaves it to the processor to tell what is late
    rows = rows.select(group.alias("group"), "key", F.unix_micros("ts").alias("t"), F.col("tie").cast("long").alias("tie"))
    return rows.groupBy("group").transformWithState(statefulProcessor=_Observe(config), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    spark.streams.active  # noqa: B018  makes the session ready to read state
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def stream_held(spark: SparkSession, checkpoint: str, config: WindowConfig) -> DataFrame:
    """(key, anchor, tie) of what a stream's window holds at its clock, from the last batch that its checkpoint has; for
    ``retained_keys``, ``flag_seen`` and the like. tie: the order among equal anchors."""
    rows = _state(spark, checkpoint, "held").select(F.col("user_map_key.key").alias("key"), F.col("user_map_value.anchor").alias("anchor"), F.col("user_map_value.place").alias("tie"))
    return fresh(rows, config, _counts(spark, checkpoint)["clock"])


def _counts(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    names = ("admitted", "repeats", "late", "evicted")
    row = _state(spark, checkpoint, "counts").agg(*(F.coalesce(F.sum(f"value.{c}"), F.lit(0)).alias(c) for c in names), F.max("value.clock").alias("clock")).first()
    return row.asDict()


def stream_stats(spark: SparkSession, checkpoint: str, config: WindowConfig) -> DataFrame:
    """One row as of ``stats``, from the last batch of a stream's checkpoint: what waits isn't counted yet."""
    c, retained = _counts(spark, checkpoint), stream_held(spark, checkpoint, config).count()
    row = {"retained": retained, "admitted": c["admitted"], "expired": c["admitted"] - retained - c["evicted"], "evicted": c["evicted"], "repeats": c["repeats"]}
    return described(spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} long" for n in row)), config)

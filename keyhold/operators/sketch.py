"""A small filter of the keys that a window holds, by time, which prunes probes before the exact join.

A key sets eight bits in one block of eight 64-bit words, a bit in each word. A sketch is a table (bucket, block, words) with
one row for each bucket of anchors and block that has keys; it is made by one aggregation that combines before it shuffles.
Sketches of one shape are merged by or-ing words, and buckets that are too old are left out. A filter may pass a key that isn't held, never
the other way round, and the join that follows decides.

For probes, the buckets are merged to at most ``blocks`` rows, which are broadcast only if that many rows fit ``BROADCAST_BYTES``;
a larger filter prunes nothing, and the exact join does all the work.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhold.operators.snapshot import flag_seen, seen_only, unseen_only

WORDS = 8
#: Bits for each key: about 3 keys in 1,000 that aren't held pass.
KEY_BITS = 12
#: Most bytes of a broadcast filter, and what a block takes in its hash table.
BROADCAST_BYTES, BLOCK_BYTES = 64 << 20, 160


def _name(word: int) -> str:
    return f"w{word}"


def _bits(key: Column) -> list[Column]:
    """The bit of each word for a key, from a hash other than the one that chooses its block."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


@dataclass(frozen=True)
class KeySketch:
    """rows: (bucket long, block long, w0 .. w7 long). A bucket holds the anchors of ``bucket_us`` microseconds."""

    rows: DataFrame
    blocks: int
    bucket_us: int

    @classmethod
    def of(cls, held: DataFrame, keys: int, bucket_us: int) -> KeySketch:
        """The sketch of (key, anchor, ...) rows. keys: how many to make room for; with more, the filter passes more."""
        if keys < 0 or bucket_us < 1:
            raise ValueError("keys must not be negative, and bucket_us at least 1")
        blocks = max(1, -(-keys * KEY_BITS // (64 * WORDS)))
        key = F.col("key")
        bucket = F.expr(f"(anchor - pmod(anchor, {bucket_us}L)) DIV {bucket_us}L")
        placed = held.filter(key.isNotNull() & F.col("anchor").isNotNull()).select(bucket.alias("bucket"), _block(key, blocks).alias("block"), *(b.alias(_name(i)) for i, b in enumerate(_bits(key))))
        return cls(_joined(placed, "bucket", "block"), blocks, bucket_us)

    def merged(self, other: KeySketch) -> KeySketch:
        """The sketch of both's keys; ValueError if their shapes differ."""
        if (self.blocks, self.bucket_us) != (other.blocks, other.bucket_us):
            raise ValueError("sketches of different shapes can't be merged")
        return KeySketch(_joined(self.rows.unionByName(other.rows), "bucket", "block"), self.blocks, self.bucket_us)

    def fresh(self, now: int, span: int | None) -> KeySketch:
        """Without the buckets whose anchors are all older than ``span`` at ``now``."""
        if span is None:
            return self
        return KeySketch(self.rows.filter((F.col("bucket") + 1) * F.lit(self.bucket_us) > F.lit(now - span)), self.blocks, self.bucket_us)

    @property
    def broadcasts(self) -> bool:
        return self.blocks * BLOCK_BYTES <= BROADCAST_BYTES

    def marked(self, probe: DataFrame, key: str, name: str) -> DataFrame:
        """The probe's rows with ``name``: false where the key surely isn't held; a null key never is."""
        k = F.col(f"`{key}`").cast("string")
        if not self.broadcasts:
            return probe.withColumn(name, k.isNotNull())
        own = f"_{uuid.uuid4().hex}"
        words = _joined(self.rows, "block").select(F.col("block").alias(f"{own}_block"), *(F.col(_name(i)).alias(f"{own}_{i}") for i in range(WORDS)))
        hit = reduce(Column.__and__, [F.col(f"{own}_{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(k))])
        both = probe.join(F.broadcast(words), _block(k, self.blocks) == F.col(f"{own}_block"), "left")
        return both.select(*(F.col(f"`{c}`") for c in probe.columns), (k.isNotNull() & F.coalesce(hit, F.lit(False))).alias(name))


def _joined(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.bit_or(_name(i)).alias(_name(i)) for i in range(WORDS)))


def _split(probe: DataFrame, sketch: KeySketch, key: str) -> tuple[DataFrame, DataFrame]:
    """The probe's rows that may be seen, and those that surely aren't."""
    name = f"_{uuid.uuid4().hex}"
    marked = sketch.marked(probe, key, name)
    return marked.filter(F.col(name)).drop(name), marked.filter(~F.col(name)).drop(name)


def flag_seen_pruned(probe: DataFrame, held: DataFrame, sketch: KeySketch, key: str = "key") -> DataFrame:
    """``flag_seen``, with only the rows that the sketch passes going into the join; it must cover all that is held."""
    likely, not_held = _split(probe, sketch, key)
    return flag_seen(likely, held, key).unionByName(not_held.withColumn("seen", F.lit(False)))


def seen_only_pruned(probe: DataFrame, held: DataFrame, sketch: KeySketch, key: str = "key") -> DataFrame:
    """``seen_only``, in the same way."""
    return seen_only(_split(probe, sketch, key)[0], held, key)


def unseen_only_pruned(probe: DataFrame, held: DataFrame, sketch: KeySketch, key: str = "key") -> DataFrame:
    """``unseen_only``, in the same way."""
    likely, not_held = _split(probe, sketch, key)
    return unseen_only(likely, held, key).unionByName(not_held)

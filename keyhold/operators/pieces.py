"""Work along each key's sightings in order, dealt out by rows, so that a frequent key lies in many tasks.

The table is range-partitioned by (key, order) into pieces. What a key carries from one row to the next is one number, its
anchor. A piece is summed up as a function, from the anchor that its first key comes with to the one that it leaves with:
a few constant stretches, and the anchor itself beyond them. Functions are put together for groups of pieces side by side;
one pass over the groups, and one within each group, then tell every piece the anchor that it begins with, and all
pieces are worked through at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyhold.sources.state import settled

#: Bytes, as the optimizer puts them, up to which a table is taken to fit a task whoever its keys are.
TASK_BYTES = 64 << 20
DIRECT = 32  # pieces whose functions are put together by one task
NEVER = np.iinfo(np.int64).max


def fits_a_task(df: DataFrame) -> bool:
    """Whether the optimizer puts the table at ``TASK_BYTES`` at most; unknown sizes count as large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= TASK_BYTES


class Rule(Protocol):
    """What is carried along a key. None: nothing yet."""

    def exits(self, b: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int | None]:
        """For one key's rows: (upto, exit) with upto ascending, and what they leave with if nothing is carried in.

        A carried anchor a leaves as the exit of the first upto above ``shift(a)``, and as a if there is none.
        """

    def shift(self, anchor: np.ndarray | int) -> np.ndarray | int: ...

    def run(self, new: np.ndarray, b: dict[str, np.ndarray], anchor: int | None) -> tuple[pa.Array, int | None]:
        """A value for each row, and what the last key leaves with. new: the row begins another key; anchor: the first key's."""


@dataclass
class FirstSighting:
    """Admissions where a repeat leaves the age alone; span None: no age is too old."""

    span: int | None

    def shift(self, anchor):
        return anchor + (self.span or 0)

    def exits(self, b):
        t = b["t"]
        if self.span is None:
            return t[:0], t[:0], int(t[0])
        n = len(t)
        after = np.searchsorted(t, t + self.span, side="right")
        at = np.where(after < n, after, np.arange(n))
        while True:  # to the last admission that follows from each row's
            further = at[at]
            if (further == at).all():
                break
            at = further
        # a carried anchor is no younger than the first row
        reach = min(n, int(after[0]) + 1)
        upto, exits = t[:reach], t[at[:reach]]
        last = np.append(exits[1:] != exits[:-1], True)
        return upto[last], exits[last], int(t[at[0]])

    def run(self, new, b, anchor):
        t, n = b["t"], len(b["t"])
        out = np.zeros(n, dtype=bool)
        starts = np.flatnonzero(new)
        first = int(starts[0]) if len(starts) else n
        if first:  # rows of the key that goes on
            begin = 0 if anchor is None else first if self.span is None else int(np.searchsorted(t[:first], anchor + self.span, side="right"))
            starts = np.append(begin, starts) if begin < first else starts
        if self.span is None:
            out[starts] = True
        elif len(starts):
            run = np.cumsum(new)
            after, at = _after(run, t, self.span), starts
            while len(at):
                out[at] = True
                to = after[at]
                inside = to < n
                to = to[inside]
                at = to[run[to] == run[at[inside]]]
        last = np.flatnonzero(out)
        same = len(last) and not new[last[-1] + 1 :].any()
        return pa.array(out), int(t[last[-1]]) if same else anchor


def _after(run: np.ndarray, t: np.ndarray, span: int) -> np.ndarray:
    """For each row the first one that is of a later run, or more than span later."""
    low = int(t.min())
    wide = int(t.max()) - low + span + 2
    if (int(run[-1]) + 2) * wide < 1 << 62:
        code = run * wide + (t - low)
        return np.searchsorted(code, code + span, side="right")
    cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
    return np.concatenate([lo + np.searchsorted(t[lo:hi], t[lo:hi] + span, side="right") for lo, hi in zip(cuts, cuts[1:])])


@dataclass
class LastSighting:
    """Admissions where a repeat refreshes the age: only the sighting before counts."""

    span: int | None

    def shift(self, anchor):
        return anchor

    def exits(self, b):
        t = b["t"]
        return np.array([NEVER]), t[-1:], int(t[-1])

    def run(self, new, b, anchor):
        t = b["t"]
        out = np.concatenate(([True], np.zeros(len(t) - 1, dtype=bool) if self.span is None else t[1:] - t[:-1] > self.span)) | new
        if not new[0] and anchor is not None:
            out[0] = self.span is not None and t[0] - anchor > self.span
        return pa.array(out), int(t[-1])


@dataclass
class AsOf:
    """The latest anchor at or before each row; rows whose ``anchors`` is true bring one."""

    def shift(self, anchor):
        return anchor

    def exits(self, b):
        t = b["t"][b["anchors"]]
        return (np.array([NEVER]), t[-1:], int(t[-1])) if len(t) else (t, t, None)

    def run(self, new, b, anchor):
        t, n = b["t"], len(b["t"])
        run = np.cumsum(new)
        at = np.maximum.accumulate(np.where(b["anchors"], np.arange(n), -1))
        own = (at >= 0) & (run[at] == run)
        carried = ~own & (run == 0) & (anchor is not None)
        value = np.where(own, t[at], anchor if anchor is not None else 0)
        none = ~(own | carried)
        return pa.array(value, pa.int64(), mask=none), None if none[-1] else int(value[-1])


@dataclass
class Piece:
    """A piece, or some in a row, as a function. whole: all of it is one key's, and so what is carried in matters at its end."""

    first: Any
    last: Any
    whole: bool
    upto: np.ndarray
    exit: np.ndarray
    fresh: int | None  # what a whole piece leaves with if nothing is carried in
    anchor: int | None  # what leaves if it isn't whole

    def of(self, rule: Rule, key: Any, anchor: int | None) -> int | None:
        """What leaves, if this comes in."""
        if not self.whole:
            return self.anchor
        if key != self.first or anchor is None:
            return self.fresh
        at = int(np.searchsorted(self.upto, rule.shift(anchor), side="right"))
        return int(self.exit[at]) if at < len(self.upto) else anchor

    def then(self, rule: Rule, other: Piece) -> Piece:
        if not self.whole or self.last != other.first:
            entry = None if self.whole and self.last != other.first else self.anchor
            return Piece(self.first, other.last, False, self.upto[:0], self.exit[:0], None, other.of(rule, self.last, entry))
        if not other.whole:
            return Piece(self.first, other.last, False, self.upto[:0], self.exit[:0], None, other.anchor)
        at = np.searchsorted(other.upto, rule.shift(self.exit), side="right")
        exits = np.where(at < len(other.upto), np.append(other.exit, 0)[at], self.exit)
        more = other.upto > (self.upto[-1] if len(self.upto) else np.iinfo(np.int64).min)
        upto, exits = np.append(self.upto, other.upto[more]), np.append(exits, other.exit[more])
        last = np.append(exits[1:] != exits[:-1], True) if len(exits) else np.zeros(0, dtype=bool)
        fresh = other.of(rule, self.last, self.fresh)
        return Piece(self.first, other.last, True, upto[last], exits[last], fresh, None)


def along_keys(rows: DataFrame, order: list[Column], rule: Rule, needs: list[str], value: str, kind: T.DataType, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``value``, what the rule gives each row.

    rows: with ``key`` (without nulls) and the columns ``needs`` that the rule looks at, without nulls; none may be called
    _part or like ``value``. order: of a key's rows; those equal in it are taken in any order. A table that fits a task
    is dealt out by key; a larger one is written once, in order, and read twice. An empty table gives no rows.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(value, kind)])
    names = rows.columns

    def worked(b: pa.RecordBatch, last: Any, carried: int | None, begun: bool) -> tuple[pa.RecordBatch, Any, int | None]:
        keys = b["key"].to_numpy(zero_copy_only=False)
        new = np.concatenate(([not begun or keys[0] != last], keys[1:] != keys[:-1])).astype(bool)
        out, anchor = rule.run(new, {c: b[c].to_numpy(zero_copy_only=False) for c in needs}, carried if begun and keys[0] == last else None)
        return pa.RecordBatch.from_arrays([*(b[c] for c in names), out], [*names, value]), keys[-1], anchor

    if fits_a_task(rows):

        def by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, anchor, begun = None, None, False
            for b in batches:
                if b.num_rows:
                    out, last, anchor = worked(b, last, anchor, begun)
                    begun = True
                    yield out

        return rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(by_key, schema)

    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(rows.repartitionByRange(tasks, "key", *order).sortWithinPartitions("key", *order).withColumn("_part", F.spark_partition_id()))
    entries = _entries(placed, rule, needs)

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = last = anchor = None
        for whole in batches:
            for b in _by_part(whole):
                at, begun = b["_part"][0].as_py(), True
                if at != part:
                    part = at
                    begun, last, anchor = at in entries, b["key"][0].as_py(), entries.get(at)
                out, last, anchor = worked(b, last, anchor, begun)
                yield out

    return placed.mapInArrow(marked, schema)


def _by_part(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    parts = b["_part"].to_numpy()
    cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), b.num_rows]
    yield from (b.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:]) if hi > lo)


def _entries(placed: DataFrame, rule: Rule, needs: list[str]) -> dict[int, int]:
    """The anchor that each piece's first key comes with, where it comes with one: at most a number a piece."""
    key = placed.schema["key"]
    fields = [T.StructField("part", T.IntegerType()), T.StructField("first", key.dataType), T.StructField("last", key.dataType), T.StructField("whole", T.BooleanType())]
    fields += [T.StructField(c, T.BinaryType()) for c in ("upto", "exit")] + [T.StructField(c, T.LongType()) for c in ("fresh", "anchor")]
    schema = T.StructType(fields)
    names = [f.name for f in fields]

    def batch(rows: list[tuple[int, Piece]], like: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int32(), like, like, pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        flat = [(i, p.first, p.last, p.whole, p.upto.astype(np.int64).tobytes(), p.exit.astype(np.int64).tobytes(), p.fresh, p.anchor) for i, p in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in flat], k) for j, k in enumerate(kinds)], names)

    def pieces(b: pa.RecordBatch) -> Iterator[tuple[int, Piece]]:
        for r in b.to_pylist():
            yield r["part"], Piece(r["first"], r["last"], r["whole"], np.frombuffer(r["upto"], dtype=np.int64), np.frombuffer(r["exit"], dtype=np.int64), r["fresh"], r["anchor"])

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, anchor, head, like = None, None, None, None, [], None

        def done() -> pa.RecordBatch:
            upto, exits, fresh = rule.exits({c: np.concatenate([h[c] for h in head]) for c in needs})
            return batch([(part, Piece(first, last, first == last, upto, exits, fresh, None if first == last else anchor))], like)

        for whole in batches:
            for b in _by_part(whole):
                keys, cols = b["key"].to_numpy(zero_copy_only=False), {c: b[c].to_numpy(zero_copy_only=False) for c in needs}
                at, like = b["_part"][0].as_py(), b["key"].type
                if at != part:
                    if part is not None:
                        yield done()
                    part, first, last, anchor, head = at, b["key"][0].as_py(), b["key"][0].as_py(), None, []
                new = np.concatenate(([keys[0] != last], keys[1:] != keys[:-1])).astype(bool)
                if last == first:
                    ends = np.flatnonzero(new)
                    head.append({c: x[: ends[0] if len(ends) else None] for c, x in cols.items()})
                _, anchor = rule.run(new, cols, anchor)
                last = b["key"][b.num_rows - 1].as_py()
        if part is not None:
            yield done()

    found = settled(placed.select("key", "_part", *needs).mapInArrow(summed, schema))
    last = found.agg(F.max("part")).first()[0]
    if last is None:
        return {}
    size = last + 1 if last < DIRECT else math.ceil(math.sqrt(last + 1))
    groups = last // size + 1
    of = F.floor(F.col("part") / size).cast("int")

    def together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, all_ = None, None
        for b in batches:
            for i, p in pieces(b):
                if i // size == group:
                    all_ = all_.then(rule, p)
                else:
                    if all_ is not None:
                        yield batch([(group, all_)], b["first"].type)
                    group, all_ = i // size, p
        if all_ is not None:
            yield batch([(group, all_)], b["first"].type)

    def threaded(starts: dict[int, tuple[Any, int | None]] | None):
        """Each piece with the anchor that it begins with; starts: what the groups begin with, None for one group of all."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key = anchor = group = None
            for b in batches:
                out = []
                for i, p in pieces(b):
                    if starts is not None and i // size != group:
                        group = i // size
                        key, anchor = starts.get(group, (None, None))
                    if key == p.first and anchor is not None:
                        out.append((i, anchor))
                    anchor, key = p.of(rule, key, anchor), p.last
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64())], ["part", "begins"])

        return run

    if groups == 1:
        return {r.part: r.begins for r in found.coalesce(1).sortWithinPartitions("part").mapInArrow(threaded(None), "part int, begins long").collect()}
    dealt = found.repartitionById(groups, of).sortWithinPartitions("part")
    whole = dealt.mapInArrow(together, schema).coalesce(1).sortWithinPartitions("part")
    heads = {r.part: r.begins for r in whole.mapInArrow(threaded(None), "part int, begins long").collect()}
    firsts = {r.group: r.first for r in found.groupBy(of.alias("group")).agg(F.min_by("first", "part").alias("first")).collect()}
    starts = {g: (firsts[g], a) for g, a in heads.items()}
    return {r.part: r.begins for r in dealt.mapInArrow(threaded(starts), "part int, begins long").collect()}

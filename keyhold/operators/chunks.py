"""Work along all sightings in order of time with a state that every key may change, in chunks side by side.

The table is range-partitioned by (t, tie) into chunks. A chunk's result depends on the state before it, which is guessed
at first: empty. Where a gap of more than the span lies before a chunk, it is empty in fact. Then the chunks whose guess
was wrong, and only these, are worked through again from what the chunk before now leaves, until no guess is wrong. A
state that the chunk's own rows have displaced wholly no longer depends on what came before: with refreshing, a second
round ends it where a chunk has as many keys as the window has room. Where a round leaves more than half of the
wrong chunks wrong, differences don't die out, and a round takes the first chunk of each stretch of wrong ones only, a task
each, so that no task holds more than a chunk; that is the worst case, with stretches between gaps still side by side.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyhold.config import WindowConfig
from keyhold.operators.pieces import fits_a_task
from keyhold.sources.state import delete, settled, shared_folder

#: Rows of a chunk, and how often they must outnumber the keys of a state.
CHUNK_ROWS, CHUNK_SHARE = 1_000_000, 8


class WindowFold:
    """A window of bounded room. Gives admitted, and how many keys each sighting makes leave: by age, for want of room."""

    kinds = {"admitted": T.BooleanType(), "expired": T.LongType(), "evicted": T.LongType()}

    def __init__(self, config: WindowConfig) -> None:
        self.config, self.held = config, OrderedDict()  # anchors, oldest first

    def load(self, key: str, t: int) -> None:
        self.held[key] = t

    def state(self) -> Iterable[tuple[str, int]]:
        return self.held.items()

    def rows(self, keys: list[str], times: list[int]) -> list[np.ndarray]:
        span, capacity, policy, held = self.config.span_us, self.config.capacity, self.config.policy, self.held
        admitted = np.zeros(len(keys), dtype=bool)
        expired, evicted = np.zeros((2, len(keys)), dtype=np.int64)
        for i, (key, t) in enumerate(zip(keys, times)):
            while span is not None and held and t - next(iter(held.values())) > span:
                held.popitem(last=False)
                expired[i] += 1
            if key in held:
                if policy == "last":
                    held[key] = t
                    held.move_to_end(key)
                continue
            if len(held) >= capacity:
                if policy == "refuse":
                    continue
                held.popitem(last=False)
                evicted[i] = 1
            held[key], admitted[i] = t, True
        return [admitted, expired, evicted]


class DistanceFold:
    """The ``most`` keys seen latest. Gives the number of other keys since the key was seen, and how long ago that was."""

    kinds = {"distance": T.LongType(), "age": T.LongType()}

    def __init__(self, most: int) -> None:
        self.most = most
        self.seen: OrderedDict[str, tuple[int, int]] = OrderedDict()  # (place, time), oldest first
        self.tree, self.next = [0] * (2 * most + 2), 0  # counts of the places that are a key's latest

    def load(self, key: str, t: int) -> None:
        self._put(key, t)

    def state(self) -> Iterable[tuple[str, int]]:
        return ((k, t) for k, (_, t) in self.seen.items())

    def _add(self, place: int, by: int) -> None:
        place += 1
        while place < len(self.tree):
            self.tree[place] += by
            place += place & -place

    def _upto(self, place: int) -> int:
        place, total = place + 1, 0
        while place:
            total += self.tree[place]
            place &= place - 1
        return total

    def _put(self, key: str, t: int) -> None:
        if self.next > 2 * self.most:  # number the places anew
            self.tree, self.next, old = [0] * len(self.tree), 0, self.seen
            self.seen = OrderedDict()
            for k, (_, at) in old.items():
                self._put(k, at)
        self.seen[key] = (self.next, t)
        self.seen.move_to_end(key)
        self._add(self.next, 1)
        self.next += 1
        if len(self.seen) > self.most:
            self._add(self.seen.popitem(last=False)[1][0], -1)

    def rows(self, keys: list[str], times: list[int]) -> list[list[int | None]]:
        distance: list[int | None] = [None] * len(keys)
        age = distance.copy()
        for i, (key, t) in enumerate(zip(keys, times)):
            if key in self.seen:
                place, at = self.seen.pop(key)
                distance[i], age[i] = len(self.seen) + 1 - self._upto(place), t - at
                self._add(place, -1)
            self._put(key, t)
        return [distance, age]


Fold = WindowFold | DistanceFold


def _name(fold: Fold) -> str:
    digest = hashlib.blake2b(digest_size=16)
    for key, t in fold.state():
        digest.update(f"{len(key)}:{key}{t};".encode("utf-8", "surrogatepass"))
    return digest.hexdigest()


EMPTY = hashlib.blake2b(digest_size=16).hexdigest()
STATE = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("key", T.StringType()), T.StructField("t", T.LongType()), T.StructField("name", T.StringType())])


def along_time(rows: DataFrame, make: Callable[[], Fold], kinds: dict[str, T.DataType], room: int, span: int | None) -> DataFrame:
    """``rows`` (with key, t, tie) and the columns that the fold gives, ``kinds``; columns of these names are replaced.

    room: keys that a state may hold. span: after a gap of more than this the state is empty; None: never. A table that
    fits a task and has no more rows than a chunk is one. No column may be called _chunk, _old or _place. An empty table gives no rows.
    """
    rows = rows.drop(*kinds)
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, k) for c, k in kinds.items())])

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order, by chunk; those whose _old is true are the state before it, and go."""
        fold, chunk = make(), None
        for whole in batches:
            for b, at, old in _runs(whole):
                if at != chunk:
                    fold, chunk = make(), at
                keys, times = b["key"].to_pylist(), b["t"].to_pylist()
                if old:
                    for k, t in zip(keys, times):
                        fold.load(k, t)
                    continue
                out = fold.rows(keys, times)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *map(pa.array, out)], [*names, *kinds]).cast(_arrow(b, names, kinds))

    own = rows.withColumns({"_chunk": F.lit(0), "_old": F.lit(False)})
    spark, count, size = rows.sparkSession, rows.count(), max(CHUNK_ROWS, CHUNK_SHARE * room)
    if count <= size and fits_a_task(rows):  # few bytes in a file may be many rows
        return own.coalesce(1).sortWithinPartitions("t", "tie").mapInArrow(folded, schema)

    placed = settled(rows.repartitionByRange(max(1, math.ceil(count / size)), "t", "tie").withColumn("_chunk", F.spark_partition_id()))
    ends = sorted(map(tuple, placed.groupBy("_chunk").agg(F.min("t"), F.max("t")).collect()))
    before = {c: b for (b, _, _), (c, _, _) in zip(ends, ends[1:])}
    open_ = {c: b for (b, _, hi), (c, lo, _) in zip(ends, ends[1:]) if span is None or lo - hi <= span}  # without a gap

    def left(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each chunk leaves: its keys in order, and a row with its name."""
        fold, chunk = None, None

        def told() -> Iterator[pa.RecordBatch]:
            state = [*fold.state()]
            cols = [[chunk] * (len(state) + 1), range(-1, len(state)), [None, *(k for k, _ in state)], [None, *(t for _, t in state)], [_name(fold), *([None] * len(state))]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()))], STATE.names)

        for whole in batches:
            for b, at, old in _runs(whole):
                if at != chunk:
                    if fold is not None:
                        yield from told()
                    fold, chunk = make(), at
                keys, times = b["key"].to_pylist(), b["t"].to_pylist()
                if old:
                    for k, t in zip(keys, times):
                        fold.load(k, t)
                else:
                    fold.rows(keys, times)
        if fold is not None:
            yield from told()

    def dealt(table: DataFrame, chunks: list[int] | None, states: DataFrame | None) -> DataFrame:
        """The table's rows of these chunks (None: all), in order, after the states before them; a task a chunk."""
        some = table if chunks is None else table.filter(F.col("_chunk").isin(chunks))
        both = some.withColumns({"_old": F.lit(False), "_place": F.lit(0).cast("long")})
        after = {before[c]: c for c in (before if chunks is None else chunks) if c in before}
        if states is not None and after:
            to = spark.createDataFrame(list(after.items()), "chunk int, _chunk int")
            old = states.filter("place >= 0").join(F.broadcast(to), "chunk")
            both = both.unionByName(old.select("_chunk", "key", "t", F.col("place").alias("_place"), F.lit(True).alias("_old")), allowMissingColumns=True)
        tasks = len(ends) if chunks is None else len(chunks)
        task = F.col("_chunk") if chunks is None else F.array_position(F.array(*map(F.lit, chunks)), F.col("_chunk")).cast("int") - 1
        return both.repartitionById(max(1, tasks), task).sortWithinPartitions("_chunk", F.desc("_old"), "_place", "t", "tie")

    states = settled(dealt(placed, None, None).select("_chunk", "_old", "key", "t").mapInArrow(left, STATE))
    leaves = _names(states)
    taken, were, lean, path = dict.fromkeys(open_, EMPTY), 0, None, f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    try:
        while wrong := sorted(c for c, b in open_.items() if taken[c] != leaves[b]):
            now = wrong
            if were and 2 * len(wrong) > were:
                now = [c for c in wrong if open_[c] not in set(wrong)]
                if lean is None:  # by chunk, so that a round reads its own chunks alone
                    own = placed.select("key", "t", "tie", "_chunk")
                    own.write.partitionBy("_chunk").parquet(path)
                    lean = spark.read.schema(own.schema).parquet(path)
            taken |= {c: leaves[open_[c]] for c in now}
            again = dealt(placed if lean is None else lean, now, states).select("_chunk", "_old", "key", "t").mapInArrow(left, STATE)
            states = settled(states.filter(~F.col("chunk").isin(now)).unionByName(again))
            leaves = _names(states)
            were = len(wrong)
    finally:
        if lean is not None:
            delete(spark, path)
    # after a gap the state before tells what left by age
    return dealt(placed, None, states).drop("_place").mapInArrow(folded, schema)


def _names(states: DataFrame) -> dict[int, str]:
    """One digest a chunk."""
    return {r.chunk: r.name for r in states.filter("place < 0").select("chunk", "name").collect()}


def _runs(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, bool]]:
    if not b.num_rows:
        return
    chunks, old = b["_chunk"].to_numpy(), b["_old"].to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((chunks[1:] != chunks[:-1]) | (old[1:] != old[:-1])) + 1).tolist(), b.num_rows]
    yield from ((b.slice(lo, hi - lo), int(chunks[lo]), bool(old[lo])) for lo, hi in zip(cuts, cuts[1:]))


def _arrow(b: pa.RecordBatch, names: list[str], kinds: dict[str, T.DataType]) -> pa.Schema:
    made = {T.BooleanType(): pa.bool_(), T.LongType(): pa.int64()}
    return pa.schema([*(b.schema.field(c) for c in names), *(pa.field(c, made[k]) for c, k in kinds.items())])

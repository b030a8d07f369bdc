"""Running totals for each key over an ordered table, without gathering a key's rows in one task.

The table is range-partitioned by (key, order) by rows, so a frequent key lies in many partitions. Each partition is
scanned by itself; what a key's earlier partitions add up to is one row a partition, and is added where a key goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Settle = Callable[[DataFrame], DataFrame]


def scan(rows: DataFrame, key: str, order: list[Column], sums: list[str], settle: Settle, tasks: int) -> DataFrame:
    """``rows`` with ``pos`` (from 0, within the key in this order) and ``run_<c>`` for each c of ``sums``: its total so far.

    key: a column of whole numbers or text without nulls. sums: long columns without nulls; totals must fit a long. Rows
    that are equal in key and order are put in any order. settle: writes a table and gives it back, as the partitions
    must not change between the passes. ``rows`` must not have columns of the names that are made here. One row a
    partition comes to the driver. An empty table gives no rows.
    """
    made = [f"run_{c}" for c in sums]
    fields = [T.StructField(c, T.LongType()) for c in ("pos", *made, "_part", "_row")]
    schema = T.StructType([*rows.schema.fields, *fields, T.StructField("_first", T.BooleanType())])
    names = [f.name for f in schema.fields]

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The totals within the partition; _first: the row belongs to the key that the partition begins with."""
        part, seen, first_key, last = TaskContext.get().partitionId(), 0, None, None
        count, totals = 0, [0] * len(sums)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b[key].to_numpy(zero_copy_only=False)
            if not seen:
                first_key = last = keys[0]
            new = np.concatenate(([keys[0] != last], keys[1:] != keys[:-1])).astype(bool)
            run = np.cumsum(new)  # 0: goes on from the batch before
            at = np.concatenate(([0], np.flatnonzero(new)))[run]  # where the row's run begins
            on = run == 0
            pos = np.arange(n) - at + np.where(on, count, 0)
            cols = []
            for i, c in enumerate(sums):
                upto = np.concatenate(([0], np.cumsum(b[c].to_numpy(zero_copy_only=False).astype(np.int64))))
                cols.append(upto[1:] - upto[at] + np.where(on, totals[i], 0))
            count, totals, last = int(pos[-1]) + 1, [int(c[-1]) for c in cols], keys[-1]
            long = [pos, *cols, np.full(n, part), np.arange(seen, seen + n)]
            seen += n
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in long), pa.array(keys == first_key, pa.bool_())], names=names)

    placed = rows.repartitionByRange(tasks, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    done = settle(placed.mapInArrow(local, schema))
    ends = done.groupBy("_part").agg(F.min_by(key, "_row").alias("head"), F.max_by(F.struct(F.col(key).alias("key"), "pos", *made), "_row").alias("tail"))
    carried, key_now, sum_now = [], None, (0,) * (1 + len(sums))
    for r in sorted(ends.collect()):
        own = (r.tail.pos + 1, *(r.tail[c] for c in made))
        if r.head == key_now:
            carried.append((r._part, *sum_now))
        if r.head == r.tail.key:
            sum_now = tuple(x + y for x, y in zip(own, sum_now)) if r.head == key_now else own
        else:
            sum_now = own
        key_now = r.tail.key
    before = [f"_{c}" for c in ("pos", *made)]
    if not carried:
        return done.drop("_part", "_row", "_first")
    offsets = rows.sparkSession.createDataFrame(carried, "_at long, " + ", ".join(f"{c} long" for c in before))
    out = done.join(F.broadcast(offsets), F.col("_first") & (F.col("_part") == F.col("_at")), "left")
    out = out.withColumns({c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in ("pos", *made)})
    return out.drop("_part", "_row", "_first", "_at", *before)

"""observe in SQL, as a table function.

    register(spark)
    SELECT * FROM keyhold_observe(TABLE(events), 'user_id', 'ts', 'event_id', 3600000000, NULL, 'first')

The function asks for its rows by key and in order itself, and passes them by one at a time; with a capacity it takes them
all in one task, as each admission may depend on all earlier ones. ``keyhold.operators.admit`` deals out the same work
further, over DataFrames.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from datetime import date, datetime
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf

from keyhold.config import WindowConfig

NAME = "keyhold_observe"
MARK = "admitted"


class Observe:
    """The table's columns and ``admitted``; rows with a null key, time or tie are left out, as in ``sightings``."""

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, time: AnalyzeArgument, tie: AnalyzeArgument, span: AnalyzeArgument, capacity: AnalyzeArgument, policy: AnalyzeArgument) -> AnalyzeResult:
        WindowConfig(span.value, capacity.value, policy.value)  # ValueError if there's no such window
        names = table.dataType.names
        for c in (key.value, time.value, tie.value):
            if c not in names:
                raise ValueError(f"the table has no column {c}")
        if not isinstance(table.dataType[time.value].dataType, (T.IntegralType, T.TimestampNTZType, T.DateType)):
            raise TypeError(f"{time.value} must be a number of microseconds, a timestamp without a zone or a date")
        if MARK in names:
            raise ValueError(f"the table has a column {MARK} already")
        alone = capacity.value is not None
        at, place, by = (f"`{c.replace('`', '``')}`" for c in (time.value, tie.value, key.value))
        return AnalyzeResult(T.StructType([*table.dataType.fields, T.StructField(MARK, T.BooleanType())]), withSinglePartition=alone, partitionBy=[] if alone else [PartitioningColumn(by)], orderBy=[OrderingColumn(at), OrderingColumn(place)])

    def __init__(self) -> None:
        self.held: OrderedDict[Any, int] = OrderedDict()  # anchors, oldest first

    def eval(self, table: Row, key: str, time: str, tie: str, span: int | None, capacity: int | None, policy: str) -> Iterator[tuple]:
        k, at, held = table[key], table[time], self.held
        if k is None or at is None or table[tie] is None:
            return
        t = _micros(at)
        while span is not None and held and t - next(iter(held.values())) > span:
            held.popitem(last=False)
        new = k not in held
        if not new and policy == "last":
            held[k] = t
            held.move_to_end(k)
        elif new and capacity is not None and len(held) >= capacity and policy == "refuse":
            new = False
        elif new:
            if capacity is not None and len(held) >= capacity:
                held.popitem(last=False)
            held[k] = t
        yield (*table, new)


def _micros(at: int | date) -> int:
    if isinstance(at, int):
        return at
    whole = at if isinstance(at, datetime) else datetime(at.year, at.month, at.day)
    past = whole - datetime(1970, 1, 1)
    return (past.days * 86_400 + past.seconds) * 1_000_000 + past.microseconds


def register(spark: SparkSession) -> None:
    """Make ``keyhold_observe`` known to the session."""
    spark.udtf.register(NAME, udtf(Observe))

"""observe: mark each sighting as newly admitted or a repeat.

All functions take the columns of :func:`keyhold.functions.sightings` and add ``admitted``. Sightings are ordered by
(t, tie); of rows equal in key, t and tie one counts as the first. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyhold.config import WindowConfig
from keyhold.operators.chunks import DistanceFold, WindowFold, along_time
from keyhold.operators.pieces import AsOf, FirstSighting, LastSighting, along_keys, fits_a_task


def admit(sighted: DataFrame, config: WindowConfig) -> DataFrame:
    """The sightings with ``admitted``.

    Without a capacity, keys don't interact: see ``pieces``. With one, they do: see ``chunks``.
    """
    if config.capacity is not None:
        return departures(sighted, config).drop("expired", "evicted")
    order = [F.col("t"), F.col("tie")]
    refreshed = config.policy == "last" or config.span_us is None
    if refreshed and fits_a_task(sighted):
        before = F.lag("t").over(Window.partitionBy("key").orderBy(*order))
        old = F.lit(False) if config.span_us is None else F.col("t") - before > F.lit(config.span_us)
        return sighted.withColumn("admitted", before.isNull() | old)
    rule = LastSighting(config.span_us) if refreshed else FirstSighting(config.span_us)
    return along_keys(sighted, order, rule, ["t"], "admitted", T.BooleanType())


def departures(sighted: DataFrame, config: WindowConfig) -> DataFrame:
    """The sightings with ``admitted``, and how many keys each makes leave: ``expired`` by age, ``evicted`` for want of room.

    Needs a capacity. Columns of these names are replaced.
    """
    return along_time(sighted, lambda: WindowFold(config), WindowFold.kinds, config.capacity, config.span_us)


def reuse_distance(sighted: DataFrame, most: int) -> DataFrame:
    """The sightings with ``distance`` and ``age``: how many other keys were seen since the key was, and the time since.

    Both are null where the key wasn't seen before, or ``most`` or more others were seen since; a task holds that many keys.
    With refreshing, a window of any capacity up to ``most`` admits a sighting if its distance is null or not below the
    capacity, or its age above the span (``admitted_at``). So one pass answers for all capacities.
    """
    if most < 1:
        raise ValueError("most must be at least 1")
    return along_time(sighted, lambda: DistanceFold(most), DistanceFold.kinds, most, None)


def admitted_at(capacity: int, span: int | None = None) -> Column:
    """Over ``reuse_distance``: whether a refreshing window of these bounds admits the sighting; the capacity is at most ``most``."""
    old = F.lit(False) if span is None else F.col("age") > F.lit(span)
    return F.col("distance").isNull() | (F.col("distance") >= capacity) | old


def seen_asof(probe: DataFrame, sighted: DataFrame, config: WindowConfig, key: str = "key", time: str = "t") -> DataFrame:
    """The probe's rows with ``seen``: whether the window held the key at the row's own time, sightings of that time included.

    time: a column of microseconds. A null key or time is never seen. A column ``seen`` is replaced, others are kept whatever
    their names. The window must have no capacity.
    """
    if config.capacity is not None:
        raise ValueError("seen_asof needs a window without a capacity")
    own = [c for c in probe.columns if c != "seen"]
    anchors = sighted if config.policy == "last" else admit(sighted, config).filter("admitted")
    asks = probe.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{time}`").cast("long").alias("t"), F.lit(False).alias("anchors"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in own)).alias("row"))
    lost = asks.filter("key IS NULL OR t IS NULL").select("row", F.lit(False).alias("seen"))
    both = anchors.select("key", "t", F.lit(True).alias("anchors")).unionByName(asks.filter("key IS NOT NULL AND t IS NOT NULL"), allowMissingColumns=True)
    order = [F.col("t"), F.col("anchors").desc()]
    if fits_a_task(both):
        last = F.last(F.when(F.col("anchors"), F.col("t")), ignorenulls=True).over(Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        told = both.withColumn("anchor", last)
    else:
        told = along_keys(both, order, AsOf(), ["t", "anchors"], "anchor", T.LongType())
    fresh = F.lit(True) if config.span_us is None else F.col("t") - F.col("anchor") <= F.lit(config.span_us)
    told = told.filter(~F.col("anchors")).select("row", (F.col("anchor").isNotNull() & fresh).alias("seen"))
    return told.unionByName(lost).select(*(F.col(f"row.`{c}`").alias(c) for c in own), "seen")

"""seen, advance, keys and stats over a window's contents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhold.config import WindowConfig
from keyhold.operators.admission import admit, departures
from keyhold.sources.state import settled

#: Most keys that one task takes to find the newest.
TAKE_ROWS = 100_000


def snapshot(sighted: DataFrame, config: WindowConfig, now: int | None = None) -> DataFrame:
    """(key, anchor, tie): the keys that the window holds after the last sighting up to ``now``.

    now: microseconds; None: the time of the last sighting. The anchor of a key is the time its age counts from.
    """
    upto = sighted if now is None else sighted.filter(F.col("t") <= F.lit(now))
    # with refreshing, every sighting counts, admitted or not
    marked = upto.withColumn("admitted", F.lit(True)) if config.policy == "last" else admit(upto, config)
    end = None if config.span_us is None or now is not None else upto.agg(F.max("t").alias("_now"))
    return held_after(marked, config, now if end is None else end)


def held_after(marked: DataFrame, config: WindowConfig, now: int | DataFrame | None) -> DataFrame:
    """What is held after sightings that ``admit`` has marked, at ``now``: a time, or a row with ``_now``; needed with a span."""
    counts = marked if config.policy == "last" else marked.filter("admitted")
    latest = counts.groupBy("key").agg(F.max(F.struct("t", "tie")).alias("at")).select("key", F.col("at.t").alias("anchor"), F.col("at.tie").alias("tie"))
    if config.capacity is not None and config.policy != "refuse":
        # what was dropped for want of room is older than all that is held
        latest = newest(latest, config.capacity)
    if config.span_us is None:
        return latest
    if isinstance(now, DataFrame):
        return latest.join(F.broadcast(now), F.col("_now") - F.col("anchor") <= config.span_us).drop("_now")
    return latest.filter(F.lit(now) - F.col("anchor") <= config.span_us)


def newest(held: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows that come last by (anchor, tie).

    Few meet in one task. Many are dealt to tasks by range and counted there: pieces before the one with the last place are
    taken whole, and only that one is cut.
    """
    order = [F.desc("anchor"), F.desc("tie")]
    if most <= TAKE_ROWS:
        return held.orderBy(*order).limit(most)
    pieces = settled(held.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()))
    room = most
    for piece, rows in sorted((r["_piece"], r["count"]) for r in pieces.groupBy("_piece").count().collect()):
        if rows > room:
            cut = pieces.filter(F.col("_piece") == piece).orderBy(*order).limit(room)
            return pieces.filter(F.col("_piece") < piece).unionByName(cut).drop("_piece")
        room -= rows
    return pieces.drop("_piece")


def _stale(config: WindowConfig, now: int | None) -> Column:
    return F.lit(False) if config.span_us is None or now is None else F.lit(now) - F.col("anchor") > config.span_us


def advance(held: DataFrame, config: WindowConfig, now: int) -> tuple[DataFrame, DataFrame]:
    """What is still held at ``now``, and a row with ``dropped``: how many keys were too old."""
    return fresh(held, config, now), held.agg(F.count_if(_stale(config, now)).alias("dropped"))


def fresh(held: DataFrame, config: WindowConfig, now: int | None) -> DataFrame:
    """Of what is held, the keys that aren't too old at ``now``; None: all."""
    return held.filter(~_stale(config, now))


def flag_seen(probe: DataFrame, held: DataFrame, key: str = "key") -> DataFrame:
    """The probe's rows with ``seen``; a null key is never seen. The window is left as it is."""
    own = f"_{uuid.uuid4().hex}"
    keys = held.select(F.col("key").alias(own)).distinct()
    return probe.join(keys, F.col(f"`{key}`").cast("string") == F.col(own), "left").withColumn("seen", F.col(own).isNotNull()).drop(own)


def seen_only(probe: DataFrame, held: DataFrame, key: str = "key") -> DataFrame:
    """The probe's rows whose key is held."""
    own = f"_{uuid.uuid4().hex}"
    return probe.join(held.select(F.col("key").alias(own)), F.col(f"`{key}`").cast("string") == F.col(own), "left_semi")


def unseen_only(probe: DataFrame, held: DataFrame, key: str = "key") -> DataFrame:
    """The probe's rows whose key isn't held."""
    own = f"_{uuid.uuid4().hex}"
    return probe.join(held.select(F.col("key").alias(own)), F.col(f"`{key}`").cast("string") == F.col(own), "left_anti")


def retained_keys(held: DataFrame) -> DataFrame:
    """The held keys, oldest sighting first."""
    return held.orderBy("anchor", "tie").select("key")


def marked_for_stats(sighted: DataFrame, config: WindowConfig) -> DataFrame:
    """The sightings as ``tallied`` needs them: with ``admitted``, and with a capacity also why keys leave."""
    return admit(sighted, config) if config.capacity is None else departures(sighted, config)


def tallied(marked: DataFrame, config: WindowConfig, new: Column | None = None, now: int | DataFrame | None = None) -> DataFrame:
    """One row: retained, admitted, expired (by age), evicted (for want of room), repeats; admitted and repeats of rows that are ``new``.

    marked: from ``marked_for_stats``. now: as in ``held_after``; needed with a span and no capacity.
    """
    new = F.lit(True) if new is None else new
    own = {"admitted": F.col("admitted") & new, "repeats": ~F.col("admitted") & new, "all": F.col("admitted")}
    none = F.lit(0).cast("long")
    if config.capacity is not None or config.span_us is None:
        left = [F.coalesce(F.sum(c), none).alias(c) for c in ("expired", "evicted")] if config.capacity is not None else [none.alias("expired"), none.alias("evicted")]
        out = marked.agg(*(F.count_if(c).alias(n) for n, c in own.items()), *left)
        out = out.withColumn("retained", F.col("all") - F.col("expired") - F.col("evicted"))
    else:
        anchor = F.max("t") if config.policy == "last" else F.max(F.when(F.col("admitted"), F.col("t")))
        by_key = marked.groupBy("key").agg(*(F.count_if(c).alias(n) for n, c in own.items()), anchor.alias("anchor"), F.max("t").alias("end"))
        by_key = by_key.join(F.broadcast(now), how="left") if isinstance(now, DataFrame) else by_key.withColumn("_now", F.lit(now))
        held = F.count_if(F.col("_now") - F.col("anchor") <= config.span_us).alias("retained")
        out = by_key.agg(held, *(F.coalesce(F.sum(n), none).alias(n) for n in own)).withColumns({"expired": F.col("all") - F.col("retained"), "evicted": none})
    return out.select("retained", "admitted", "expired", "evicted", "repeats")


def stats(sighted: DataFrame, config: WindowConfig) -> DataFrame:
    """One row: span, capacity, retained, admitted, expired (by age), evicted (for want of room), repeats."""
    now = sighted.agg(F.max("t").alias("_now")) if config.span_us is not None and config.capacity is None else None
    return described(tallied(marked_for_stats(sighted, config), config, now=now), config)


def described(counts: DataFrame, config: WindowConfig) -> DataFrame:
    """The counts with the window's bounds before them."""
    bounds = [F.lit(config.span_us).cast("long").alias("span"), F.lit(config.capacity).cast("long").alias("capacity")]
    return counts.select(*bounds, "retained", "admitted", "expired", "evicted", "repeats")

"""Bring a table to the columns that the window operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp (zoned or not), a date or a number of microseconds.

    Timestamps without a zone and dates count as UTC, whatever the session's zone.
    """
    kind = df.schema[name].dataType
    col = F.col(f"`{name}`")
    if isinstance(kind, T.IntegralType):
        return col.cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col.cast("timestamp_ntz"))
    raise TypeError(f"{name} is {kind.simpleString()}; a time or a number of microseconds is needed")


def sightings(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """(key string, t long, tie): one row a sighting. Rows with a null key, time or tie can't be ordered and are left out."""
    return df.select(F.col(f"`{key}`").cast("string").alias("key"), epoch_micros(df, time).alias("t"), F.col(f"`{tie}`").alias("tie")).dropna()

"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: With this, Spark removes the shuffle files of a query once it is over.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local: dict[str, str] = {}  # by application, where the setting is unset


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local one if driver and executors are one process;
    RuntimeError on a cluster, whose machines wouldn't see each other's files."""
    context = spark.sparkContext
    found = spark.conf.get(SETTING, None) or context.getConf().get(SETTING) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"{SETTING} must name a folder that all machines of the cluster share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="keyhold-")
        found = _local[context.applicationId]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


_thread = threading.local()


def _scopes() -> list[Scratch]:
    """The open blocks of this thread, the innermost last."""
    if not hasattr(_thread, "scopes"):
        _thread.scopes = []
    return _thread.scopes


class Scratch:
    """Tables that are needed within a ``with`` block alone; when it ends, all that were written in it are deleted.

    What a block is about to return goes through ``keep``, which writes it into the block around it; where there is none,
    the table stays, as its reader may come at any time.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, []  # (frame, its path)

    def __enter__(self) -> Scratch:
        _scopes().append(self)
        return self

    def __exit__(self, *error: object) -> None:
        _scopes().remove(self)
        for _, path in self.tables:
            delete(self.spark, path)
        self.tables = []

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables of this block already; nothing may read them any more."""
        for df, path in self.tables:
            if any(df is t for t in tables):
                delete(self.spark, path)
        self.tables = [x for x in self.tables if not any(x[0] is t for t in tables)]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        at = _scopes().index(self)
        return _write(df, name, _scopes()[at - 1] if at else None)


def _write(df: DataFrame, name: str, scope: Scratch | None) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if scope is not None:
        scope.tables.append((out, path))
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, from a Parquet table in the shared folder: a lost executor costs no more than its own tasks. The
    innermost open :class:`Scratch` deletes it in the end."""
    return _write(df, name, _scopes()[-1] if _scopes() else None)


def texts(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column one by one, so that a batch doesn't lie in memory twice."""
    return (x.as_py() for x in column)


def released() -> None:
    """At the end of a task: give back what Arrow keeps for later, as Python workers live on and take other tasks."""
    pa.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys with more than a thousandth of all rows (so fewer than 1,000) are joined by broadcast: none can fill a task.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, values: list[str], total: int) -> DataFrame:
    """``rows``, left-joined with the ``values`` of ``table``, which has each key once.

    weight: a column of ``table``, at least as many as ``rows`` has with the key; total: the sum of the weights, or less.
    Frequent keys reach the rows by broadcast, and those rows are then dealt out evenly. Both tables are read twice.
    """
    hot = F.col(weight) > max(1, total // HOT_SHARE)
    found = lambda name: F.struct(*(F.col(v) for v in values)).alias(name)
    near = rows.join(F.broadcast(table.filter(hot).select(*keys, found("_hot"))), keys, "left")
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)))
    cold = table.filter(~hot).select(*keys, found("_cold"), F.lit(0).cast("long").alias("_salt"))
    out = near.withColumn("_salt", salt.cast("long")).join(cold, [*keys, "_salt"], "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    return out.select(*rows.columns, *(F.col(f"_found.{v}").alias(v) for v in values))


def free(df: DataFrame, name: str) -> str:
    """A column name like this one that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

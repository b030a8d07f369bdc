"""save and load: a window's contents as versioned Parquet.

A save writes a folder of its own below ``contents`` and then an entry of ``manifest``, a file that only one saver can
create. Readers only follow the manifest, so a save that breaks off half-way leaves the last good version in force, and of
two savers that began from the same version one gets an error. A load checks what it read before it returns it.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyhold.config import WindowConfig

COUNTS = ("admitted", "expired", "evicted", "repeats", "late")
MANIFEST = "version long, span_us long, capacity long, policy string, retained long, checksum string, clock long, folder string, " + ", ".join(f"{c} long" for c in COUNTS)
HELD = ("CAST(id AS STRING) AS key", "id AS anchor", "id AS tie")  # of no rows: the optimizer knows that there are none
SHARED = "spark.checkpoint.dir"


class StaleWindowError(RuntimeError):
    """The directory has a version that the saver hasn't seen."""


@dataclass
class Saved:
    """A version of a directory; 0: it has none yet."""

    version: int = 0
    held: DataFrame | None = None
    config: WindowConfig | None = None
    clock: int | None = None
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that ``spark.checkpoint.dir`` names.

    Where nothing is set, a local folder serves a master that is one process; RuntimeError on a cluster.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        wanted = spark.conf.get(SHARED, None)
        if wanted is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError(f"{SHARED} must name a folder that all machines of the cluster share")
        context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="keyhold-window-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept in the shared folder, without the plan behind them.

    Spark deletes them once nothing refers to them any more where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    files, at = _files(spark, path)
    files.delete(at, True)


def _entries(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the manifest's entries; those of broken saves too."""
    files, at = _files(spark, f"{path}/manifest")
    return sorted(int(x.getPath().getName()[1:-5]) for x in files.listStatus(at)) if files.exists(at) else []


def _checksum(held: DataFrame) -> tuple[int, str]:
    row = held.agg(F.count("*").alias("n"), F.sum(F.xxhash64("key", "anchor", F.col("tie").cast("string")).cast("decimal(38,0)")).cast("string").alias("sum")).first()
    return row.n, row.sum or "0"


def newest(spark: SparkSession, path: str) -> int:
    """The number of the version in force; 0 if there is none."""
    return _read(spark, path)["version"] or 0


def _read(spark: SparkSession, path: str) -> dict:
    if not _entries(spark, path):
        return {"version": None}
    row = spark.read.schema(MANIFEST).json(f"{path}/manifest").filter("version IS NOT NULL AND folder IS NOT NULL").orderBy(F.desc("version")).first()
    return row.asDict() if row else {"version": None}


def save_state(saved: Saved, path: str) -> int:
    """Write a new version, and return its number.

    saved.version: the version that this one follows. StaleWindowError if another has been saved meanwhile.
    """
    held, config = saved.held, saved.config
    spark = held.sparkSession
    if (now := newest(spark, path)) != saved.version:
        raise StaleWindowError(f"{path} has version {now}; this window follows version {saved.version}")
    version = max([*_entries(spark, path), now]) + 1
    folder = f"version={version}-{uuid.uuid4().hex[:12]}"
    held.write.parquet(f"{path}/contents/{folder}")
    retained, checksum = _checksum(spark.read.parquet(f"{path}/contents/{folder}"))
    entry = {"version": version, "span_us": config.span_us, "capacity": config.capacity, "policy": config.policy, "retained": retained, "checksum": checksum, "clock": saved.clock, "folder": folder, **saved.counts}
    files, at = _files(spark, f"{path}/manifest/v{version}.json")
    try:
        out = files.create(at, False)
    except Py4JJavaError as e:
        if not files.exists(at):
            raise
        raise StaleWindowError(f"{path}: another saver wrote version {version}") from e
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    return version


def load_state(spark: SparkSession, path: str) -> Saved:
    """The version in force; one without contents if there is none. ValueError if its rows aren't those that were saved."""
    row = _read(spark, path)
    if row["version"] is None:
        return Saved()
    held = spark.read.parquet(f"{path}/contents/{row['folder']}")
    if not {"key", "anchor", "tie"} <= set(held.columns) or _checksum(held) != (row["retained"], row["checksum"]):
        raise ValueError(f"version {row['version']} in {path} is damaged")
    return Saved(row["version"], held, WindowConfig(row["span_us"], row["capacity"], row["policy"]), row["clock"], {c: row[c] or 0 for c in COUNTS})

"""A window's folder as a data source.

    register(spark)
    spark.read.format("keyhold_window").load(path)                          # the version in force
    spark.read.format("keyhold_window").option("version", 3).load(path)    # an older one
    df.write.format("keyhold_window").mode("overwrite").option("span_us", 3600000000).save(path)
    CREATE TEMPORARY VIEW held USING keyhold_window OPTIONS (path '...')

Rows are (key string, anchor long, tie long or string). A write makes a new version, in the format that ``save`` writes and
``load`` checks, once all its tasks have ended; what broken or repeated tasks wrote never counts. Options of a write: span_us,
capacity, policy, clock, the counts (admitted, expired, evicted, repeats, late; without them the rows count as admitted), and
``version``, the one that this write follows (the newest by default): if another has been saved, the write fails.

With the option ``push_filters`` set to true, which needs ``spark.sql.python.filterPushdown.enabled`` in the session, comparisons of
key and anchor skip files' row groups. Folders lie in a file system that all machines mount, or in HDFS; elsewhere there is no way here to create
an entry that only one writer gets, and ``KeyWindow.save`` serves.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from keyhold.config import WindowConfig
from keyhold.sources.state import COUNTS, StaleWindowError

NAME = "keyhold_window"
SEED = 42  # of Spark's xxhash64
COMPARED = {D.EqualTo: "__eq__", D.GreaterThan: "__gt__", D.GreaterThanOrEqual: "__ge__", D.LessThan: "__lt__", D.LessThanOrEqual: "__le__"}
#: Rows of a group in a written file. Where the written rows are sorted by key or anchor, filters skip most groups.
GROUP_ROWS = 100_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), os.path.abspath(unquote(at.path) if at.scheme else path)
    return fs.FileSystem.from_uri(path)


def _listed(files: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    return [f for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.File]


def _entries(files: fs.FileSystem, path: str) -> tuple[dict[int, dict], int]:
    """The manifest's whole entries by version, and the largest number in use, broken ones too."""
    whole, largest = {}, 0
    for f in _listed(files, f"{path}/manifest"):
        if not (f.base_name.startswith("v") and f.base_name.endswith(".json")):
            continue
        largest = max(largest, int(f.base_name[1:-5]))
        with files.open_input_stream(f.path) as rows:
            try:
                entry = json.loads(rows.read())
            except ValueError:
                continue  # a save that broke off
        if entry.get("folder"):
            whole[entry["version"]] = entry
    return whole, largest


class WindowFolder(D.DataSource):
    """The format ``keyhold_window``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _version(self) -> tuple[fs.FileSystem, str, dict]:
        files, path = _opened(self.options["path"])
        whole, _ = _entries(files, path)
        wanted = int(self.options["version"]) if "version" in self.options else max(whole, default=0)
        if wanted not in whole:
            raise ValueError(f"no saved window in {path}" if not whole else f"no version {wanted} in {path}")
        return files, path, whole[wanted]

    def schema(self) -> T.StructType:
        files, path, entry = self._version()
        parts = _parts(files, path, entry)
        tie = pq.read_schema(parts[0].path, filesystem=files).field("tie").type if parts else pa.int64()
        return T.StructType([T.StructField("key", T.StringType()), T.StructField("anchor", T.LongType()), T.StructField("tie", T.StringType() if pa.types.is_string(tie) else T.LongType())])

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        # Spark refuses readers that take filters where its setting is off, and the setting can't be seen from here
        kind = _FilteringReader if self.options.get("push_filters", "").lower() == "true" else _Reader
        return kind(self.options["path"], self._version()[2], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> D.DataSourceWriter:
        if not overwrite:
            raise ValueError("a version replaces what the window held: write it with mode overwrite")
        return _Writer(dict(self.options), schema)


def _parts(files: fs.FileSystem, path: str, entry: dict) -> list[fs.FileInfo]:
    found = _listed(files, f"{path}/contents/{entry['folder']}")
    return sorted((f for f in found if f.extension == "parquet" and f.base_name[0] not in "_."), key=lambda f: f.path)


@dataclass
class _Part(D.InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(D.DataSourceReader):
    def __init__(self, path: str, entry: dict, schema: T.StructType) -> None:
        self.path, self.entry, self.schema, self.wanted = path, entry, schema, []

    def partitions(self) -> list[_Part]:
        files, path = _opened(self.path)
        parts = _parts(files, path, self.entry)
        rows = sum(pq.read_metadata(f.path, filesystem=files).num_rows for f in parts)
        if rows != self.entry["retained"]:
            raise ValueError(f"version {self.entry['version']} in {path} is damaged: {rows} rows of {self.entry['retained']}")
        return [_Part(f.path) for f in parts]

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a version of no files
            return
        files, _ = _opened(self.path)
        test = None
        for column, how, value in self.wanted:
            one = getattr(ds.field(column), how)(pa.scalar(value))
            test = one if test is None else test & one
        kinds = pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in self.schema])
        for b in ds.dataset(partition.path, format="parquet", filesystem=files).to_batches(columns=kinds.names, filter=test):
            yield b.cast(kinds)


class _FilteringReader(_Reader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:  # noqa: N802
        """Comparisons of key and anchor with a value; Spark judges all rows again, as its comparisons are what counts."""
        for f in filters:
            if type(f) in COMPARED and f.attribute in (("key",), ("anchor",)) and f.value is not None:
                self.wanted.append((f.attribute[0], COMPARED[type(f)], f.value))
            yield f


@dataclass
class _Done(D.WriterCommitMessage):
    name: str | None
    rows: int
    checksum: int


class _Writer(D.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        kinds = {f.name: f.dataType for f in schema}
        if set(kinds) != {"key", "anchor", "tie"} or not isinstance(kinds["key"], T.StringType) or not isinstance(kinds["anchor"], T.LongType) or not isinstance(kinds["tie"], (T.StringType, T.LongType)):
            raise ValueError("rows must be key string, anchor long, tie long or string")
        number = lambda name: int(options[name]) if options.get(name) is not None else None
        self.path = options["path"]
        files, path = _opened(self.path)
        if not isinstance(files, (fs.LocalFileSystem, fs.HadoopFileSystem)):
            raise ValueError(f"{self.path}: a mounted file system or HDFS is needed")
        whole, _ = _entries(files, path)
        newest = max(whole, default=0)
        self.kinds = pa.schema([("key", pa.string()), ("anchor", pa.int64()), ("tie", pa.string() if isinstance(kinds["tie"], T.StringType) else pa.int64())])
        self.follows = newest if number("version") is None else number("version")
        if self.follows != newest:
            raise StaleWindowError(f"{path} has version {newest}; this write follows version {self.follows}")
        config = WindowConfig(number("span_us"), number("capacity"), options.get("policy", "first"))
        self.bounds = {"span_us": config.span_us, "capacity": config.capacity, "policy": config.policy, "clock": number("clock")}
        self.counts = {c: number(c) for c in COUNTS}
        self.folder = f"version={self.follows + 1}-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        """One file a task, under a name that readers pass over until the commit."""
        files, path = _opened(self.path)
        name, rows, checksum, out, sink = f"_{uuid.uuid4().hex}", 0, 0, None, None
        for b in iterator:
            if not b.num_rows:
                continue
            b = b.select(self.kinds.names).cast(self.kinds)
            if b.column("key").null_count or b.column("anchor").null_count or b.column("tie").null_count:
                raise ValueError("key, anchor and tie must not be null")
            if out is None:
                files.create_dir(f"{path}/contents/{self.folder}", recursive=True)
                sink = files.open_output_stream(f"{path}/contents/{self.folder}/{name}")
                out = pq.ParquetWriter(sink, b.schema)
            out.write_batch(b, row_group_size=GROUP_ROWS)
            rows += b.num_rows
            checksum += sum(map(_checked, b.column("key").to_pylist(), b.column("anchor").to_pylist(), b.column("tie").to_pylist()))
        if out is not None:
            out.close()
            sink.close()
        return _Done(name if rows else None, rows, checksum)

    def commit(self, messages: list[_Done | None]) -> None:
        files, path = _opened(self.path)
        at, done = f"{path}/contents/{self.folder}", [m for m in messages if m is not None and m.name]
        files.create_dir(at, recursive=True)
        files.create_dir(f"{path}/manifest", recursive=True)
        whole, largest = _entries(files, path)
        if max(whole, default=0) != self.follows:
            files.delete_dir(at)
            raise StaleWindowError(f"{path} has version {max(whole, default=0)}; this write follows version {self.follows}")
        for n, m in enumerate(done):
            files.move(f"{at}/{m.name}", f"{at}/part-{n:05d}.parquet")
        if not done:  # the columns, for readers
            with files.open_output_stream(f"{at}/part-00000.parquet") as out:
                pq.write_table(self.kinds.empty_table(), out)
        retained = sum(m.rows for m in done)
        counts = {c: x or 0 for c, x in self.counts.items()}
        if self.counts["admitted"] is None:
            counts["admitted"] = retained + counts["expired"] + counts["evicted"]
        entry = {"version": largest + 1, **self.bounds, "retained": retained, "checksum": str(sum(m.checksum for m in done)), "folder": self.folder, **counts}
        if not _created(files, f"{path}/manifest/v{largest + 1}.json", json.dumps(entry).encode()):
            files.delete_dir(at)
            raise StaleWindowError(f"{path}: another saver wrote version {largest + 1}")

    def abort(self, messages: list[_Done | None]) -> None:
        files, path = _opened(self.path)
        at = f"{path}/contents/{self.folder}"
        if files.get_file_info(at).type == fs.FileType.Directory:
            files.delete_dir(at)


def _created(files: fs.FileSystem, path: str, content: bytes) -> bool:
    """Create a file whole, under a name that isn't taken; False if it is."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/_{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(content)
    try:
        if isinstance(files, fs.LocalFileSystem):
            os.link(draft, path)  # a move would replace what lies there
            os.unlink(draft)
        else:
            files.move(draft, path)  # HDFS renames to no name that is taken
    except OSError:
        if files.get_file_info(path).type == fs.FileType.NotFound:
            raise
        files.delete_file(draft)
        return False
    return True


def _checked(key: str, anchor: int, tie: int | str) -> int:
    """What Spark's xxhash64 gives for (key, anchor, tie as text)."""
    h = xxhash.xxh64_intdigest(key.encode(), SEED)
    h = xxhash.xxh64_intdigest(anchor.to_bytes(8, "little", signed=True), h)
    h = xxhash.xxh64_intdigest(str(tie).encode(), h)
    return h - (1 << 64) if h >> 63 else h


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(WindowFolder)

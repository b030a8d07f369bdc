"""Token-id files: whole texts as ids in ascending order of doc_id, coded in independent blocks.

A dataset is three tables in one folder: ``ids`` (blocks, each with the documents that lie in it), ``shards`` (how many
ids come before each shard) and ``table`` (the frequencies that all blocks share). The blocks' own format is in
:mod:`keyhold.llm.rans`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyhold.llm import rans
from keyhold.llm.shared import Scratch, delete, new_path, partitions, released, written
from keyhold.llm.tokens import closed, encoder, slices

AT_ONCE = 32  # blocks that a task codes side by side
MAX_VOCAB = 1 << rans.SCALE  # entries of a table; the ids beyond, the rarest, share one and are stored whole
PIECE = [("ord", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("start", pa.int64()), ("n", pa.int64())]
_DOCS = "docs array<struct<ord:bigint,doc_id:bigint,part:bigint,last:boolean,start:bigint,n:bigint>>"


@dataclass(frozen=True)
class TokenFiles:
    path: str

    def ids(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/ids")

    def shards(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/shards")

    def frequencies(self, spark: SparkSession) -> tuple[np.ndarray, bool]:
        """The table, and whether its last entry is the escape that rare ids share."""
        rows = spark.read.parquet(f"{self.path}/table").collect()  # one row
        return np.frombuffer(rows[0].freq, dtype="<i8"), rows[0].escapes


class _Blocks:
    """A shard's stream of ids, cut into blocks, and the pieces of documents that lie in each."""

    def __init__(self, shard: int) -> None:
        self.shard, self.block, self.ids, self.pieces = shard, 0, np.zeros(0, dtype=np.uint32), np.zeros((len(PIECE), 0), dtype=np.int64)
        self.null = np.zeros(0, dtype=bool)  # whether a piece's doc_id is null
        self.counts = np.zeros(1, dtype=np.int64)  # of each id
        self.start = self.ordinal = 0

    def add(self, doc_id: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
        """Take up these documents; the blocks that are full go out."""
        # a document is cut where a block ends
        size = np.diff(ends, prepend=0)
        first = self.start + ends - size
        parts = (first + size - 1) // rans.BLOCK - first // rans.BLOCK + 1
        of = np.repeat(np.arange(len(size)), parts)
        part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        lo = np.maximum(first[of], (first[of] // rans.BLOCK + part) * rans.BLOCK)
        hi = np.minimum((first + size)[of], (first[of] // rans.BLOCK + part + 1) * rans.BLOCK)
        name = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
        new = np.stack((self.ordinal + of, name[of], part, (part == parts[of] - 1).astype(np.int64), first[of], hi - lo))
        self.pieces = np.concatenate((self.pieces, new), axis=1)
        self.null = np.concatenate((self.null, doc_id.is_null().to_numpy(zero_copy_only=False)[of]))
        self.ids = np.concatenate((self.ids, ids.astype(np.uint32, copy=False)))
        self.start, self.ordinal = self.start + len(ids), self.ordinal + len(size)
        new = np.bincount(ids)
        if len(new) > len(self.counts):
            self.counts = np.concatenate((self.counts, np.zeros(len(new) - len(self.counts), dtype=np.int64)))
        self.counts[: len(new)] += new
        return self._out(len(self.ids) // rans.BLOCK)

    def end(self) -> pa.RecordBatch | None:
        """The last block, with the counts of all."""
        return self._out(max(1, -(-len(self.ids) // rans.BLOCK)), self.counts) if self.start else None

    def _out(self, blocks: int, counts: np.ndarray | None = None) -> pa.RecordBatch | None:
        if not blocks:
            return None
        n = min(blocks * rans.BLOCK, len(self.ids))
        ends = np.minimum(np.arange(1, blocks + 1) * rans.BLOCK, n)
        count = np.searchsorted(np.cumsum(self.pieces[5]), ends) + 1 if n else np.zeros(1, dtype=np.int64)  # nothing may be left
        own, null = self.pieces[:, : count[-1]], self.null[: count[-1]]
        cols = [pa.array(c, mask=null) if k == "doc_id" else pa.array(c.astype(bool) if k == "last" else c) for (k, _), c in zip(PIECE, own)]
        docs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], count)), pa.int32()), pa.StructArray.from_arrays(cols, [k for k, _ in PIECE]))
        raw = []
        for x in np.split(self.ids[:n], ends[:-1]):
            raw.append(x.astype("<u2" if int(x.max(initial=0)) < 1 << 16 else "<u4").tobytes())
        counts = [None] * (blocks - 1) + [None if counts is None else counts.astype("<i8").tobytes()]
        out = pa.RecordBatch.from_arrays([pa.array(np.full(blocks, self.shard)), pa.array(np.arange(self.block, self.block + blocks)), docs, pa.array(ends - np.concatenate(([0], ends[:-1]))), pa.array(raw, pa.binary()), pa.array(counts, pa.binary())], ["shard", "block", "docs", "n", "ids", "counts"])
        self.block, self.ids, self.pieces, self.null = self.block + blocks, self.ids[n:], self.pieces[:, count[-1] :], self.null[count[-1] :]
        return out


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, text_col: str = "text") -> DataFrame:
    """(shard, block, docs, n, ids, counts): blocks of ids, with each text's end id, in ascending order of doc_id; a null text
    counts as empty. ids: little-endian, of 2 bytes where all of a block's fit, else of 4. start counts from the shard's
    first id. counts: in a shard's last block (which may be empty), how often each id occurs in it, else null.

    The texts are dealt out and sorted, so that ids never move.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = ["doc_id", "tie"]  # rows with one id, or none, may be many: they are dealt out by their texts
    dealt = rows.withColumn("tie", F.crc32(F.encode("text", "utf-8"))).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, blocks = encoder(tokenizer), _Blocks(TaskContext.get().partitionId())
        for b in batches:
            for lo, hi in slices(b["text"]):
                out = blocks.add(b["doc_id"].slice(lo, hi - lo), *closed(*enc.batch(b["text"].slice(lo, hi - lo).to_pylist()), end_id))
                if out is not None:
                    yield out
        if (out := blocks.end()) is not None:
            yield out
        released()

    return dealt.select("doc_id", "text").mapInArrow(run, f"shard long, block long, {_DOCS}, n long, ids binary, counts binary")


def _numbers(n: int, raw: pa.BinaryScalar) -> np.ndarray:
    data = raw.as_buffer()
    return np.frombuffer(data, "<u2" if data.size == 2 * n else "<u4")


def counted(tokens: DataFrame) -> tuple[np.ndarray, bool]:
    """How often each id occurs in all documents, and whether the last entry counts all those that have none.

    The driver gets a row for each of the MAX_VOCAB most frequent ids at most; where there are more, the rest share an entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b["counts"]:
                total = np.frombuffer(raw.as_buffer(), "<i8")
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    per_id = tokens.select("counts").filter("counts IS NOT NULL").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows, rest = per_id.take(MAX_VOCAB + 1), 0
    if len(rows) > MAX_VOCAB:
        rows = per_id.orderBy(F.desc("n"), "id").take(MAX_VOCAB - 1)
        rest = per_id.agg(F.sum("n")).first()[0] - sum(r.n for r in rows)
    out = np.zeros(max((r.id for r in rows), default=0) + 1 + (rest > 0), dtype=np.int64)
    for r in rows:
        out[r.id] = r.n
    if rest:
        out[-1] = rest
    return out, rest > 0


def _coded(tokens: DataFrame, freq: np.ndarray, escapes: bool) -> DataFrame:
    """(shard, block, docs, data): the blocks in their own format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(freq, escapes)
        for b in batches:
            for lo in range(0, len(b), AT_ONCE):
                some = b.slice(lo, AT_ONCE)
                data = coder.encode([_numbers(n, raw) for n, raw in zip(some["n"].to_pylist(), some["ids"])])
                yield pa.RecordBatch.from_arrays([some["shard"], some["block"], some["docs"], pa.array(data, pa.binary())], ["shard", "block", "docs", "data"])

    return tokens.mapInArrow(run, f"shard long, block long, {_DOCS}, data binary")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, text_col: str = "text") -> TokenFiles:
    """Write every row of ``docs`` (doc_id, a text) as ids to ``path``, in ascending order of doc_id; null ids come first.

    A null text counts as empty. Rows with equal ids follow each other by crc32 of their text and then the text itself.
    Other columns are not looked at. An empty table gives a dataset without blocks. A row of ``ids`` is a block: its place
    is told by shard and block.
    """
    spark, files = docs.sparkSession, TokenFiles(path)
    with Scratch(spark):
        tokens = written(tokenized(docs, tokenizer, end_id, text_col), "tokens")
        counts, escapes = counted(tokens)
        freq = rans.table(counts)
        spark.createDataFrame([(bytearray(freq.astype("<i8").tobytes()), escapes)], "freq binary, escapes boolean").write.parquet(f"{path}/table")
        _coded(tokens.filter("n > 0"), freq, escapes).write.parquet(f"{path}/ids")
        size = tokens.groupBy("shard").agg(F.sum("n").alias("ids"))  # a row a shard
        before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        size.select("shard", "ids", before.alias("before")).coalesce(1).write.parquet(f"{path}/shards")
    return files


def _read(spark: SparkSession, files: TokenFiles, of: pa.DataType, take) -> DataFrame:
    """(shard, ord, doc_id, part, last, start, n, ids) of every piece in the files; ids: what ``take`` makes of its bytes
    (little-endian, of 4 each)."""
    (freq, escapes), names = files.frequencies(spark), [k for k, _ in PIECE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(freq, escapes)
        for b in batches:
            for lo in range(0, len(b), AT_ONCE):
                some = b.slice(lo, AT_ONCE)
                pieces = pa.array(some["docs"]).flatten()
                number = some["docs"].value_lengths().to_numpy(zero_copy_only=False)
                raw = memoryview(np.concatenate(coder.decode(some["data"].to_pylist())).astype("<u4").tobytes())
                end = 4 * np.cumsum(pieces.field("n").to_numpy(zero_copy_only=False))
                found = [take(raw[i:j]) for i, j in zip([0, *end[:-1].tolist()], end.tolist())]
                shard = pa.array(np.repeat(some["shard"].to_numpy(zero_copy_only=False), number))
                yield pa.RecordBatch.from_arrays([shard, *[pieces.field(k) for k in names], pa.array(found, of)], ["shard", *names, "ids"])

    kind = "long" if of == pa.int64() else "binary"
    return files.ids(spark).select("shard", "docs", "data").mapInArrow(run, f"shard long, ord long, doc_id long, part long, last boolean, start long, n long, ids {kind}")


def decoded(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(shard, ord, doc_id, part, last, start, n, ids) of every piece in the files; ids: little-endian uint32. A document is
    one piece for each block that it lies in. A dataset without blocks gives no rows."""
    return _read(spark, files, pa.binary(), bytes)


def summary(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as read back from the files. Repeated and null ids are
    documents of their own, as they are in the files. A dataset without blocks gives no rows."""
    pieces = written(_read(spark, files, pa.int64(), zlib.crc32).withColumnRenamed("ids", "crc"), "pieces")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = []
            for parts in b["parts"].to_pylist():
                crc = 0
                for p in parts:
                    crc = rans.crc32_joined(crc, p["crc"], 4 * p["n"])
                whole.append(crc)
            yield pa.RecordBatch.from_arrays([b["shard"], b["doc_id"], b["start"], b["n"], pa.array(whole, pa.int64())], ["shard", "doc_id", "start", "n", "crc"])

    one = (F.col("part") == 0) & F.col("last")
    # a document over several blocks: a row a block
    parts = F.sort_array(F.collect_list(F.struct("part", "n", "crc"))).alias("parts")
    cut = pieces.filter(~one).groupBy("shard", "ord").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sum("n").alias("n"), parts)
    cut = cut.drop("ord").mapInArrow(join, "shard long, doc_id long, start long, n long, crc long")
    out = pieces.filter(one).select("shard", "doc_id", "start", "n", "crc").union(cut)
    before = F.broadcast(files.shards(spark).select("shard", "before"))  # a row a shard
    return out.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The summary of a dataset written for the purpose, in the shared folder, and deleted once it has been read back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    with Scratch(spark) as scratch:
        out = scratch.keep(summary(spark, write_tokens(docs, path, tokenizer, end_id)), "summary")
    delete(spark, path)
    return out

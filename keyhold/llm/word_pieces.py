"""SentencePiece encoding by a table of distinct words, and decoding.

Where no piece has a white-space marker after another character, no merge ever crosses the start of a marked word: a run
of markers and what follows it. So each different marked word of the corpus is segmented once, and texts get their ids by
joining the words' ids back in order. The texts are dealt out in slices of consecutive rows. A slice asks once for each of
its different words: they are dealt into buckets by checksum, each bucket is segmented in one place, and the answers, in
the order of the sorted words, go back to where the slice's texts are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyhold.llm.shared import partitions

MARK = "▁"
SLICE_BYTES = 16 << 20  # of text, on average; what a slice's different words take is a fraction of that
PART_SLICES = 1 << 20  # slices that an input partition can have
OUT_BYTES = 8 << 20  # of ids that are sent on at a time
PACK_BYTES = 1 << 20  # of text that is compressed together
REMEMBERED = 1_000_000  # words of a bucket whose ids are kept; beyond that, words of later slices are segmented anew


@cache
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, once a worker; ValueError if its pieces can cross a marker or its normaliser does more than mark spaces."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(len(sp))):
        raise ValueError(f"{path}: pieces cross the white-space marker")
    if sp.normalize("  a  b\t　ﬁ ") != f"{MARK * 3}a{MARK * 2}b\t　ﬁ{MARK}":
        raise ValueError(f"{path}: its normaliser changes more than spaces")
    return sp


def marked_words(text: str) -> list[str]:
    """The marked words of a text, in order, each without its first marker and with spaces for the others.

    A text has a marker in front and one for each space; a marker that it holds itself counts as a space.
    """
    if MARK in text:
        text = text.replace(MARK, " ")
    words = text.split(" ") if text else []
    if "" not in words:
        return words
    out, more = [], 0
    for w in words:
        if w:
            out.append(" " * more + w)
            more = 0
        else:
            more += 1
    return [*out, " " * (more - 1)] if more else out


def segment(path: str, words: list[str]) -> list[list[int]]:
    """The ids of each marked word by itself; the library puts the first marker in front."""
    sp = processor(path)
    return [ids or [sp.piece_to_id(MARK)] for ids in sp.encode(words, num_threads=1)]


def bucketed(words: Iterable[str], buckets: int) -> dict[int, list[str]]:
    """The words by bucket, in order."""
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets, []).append(w)
    for some in out.values():
        some.sort()
    return out


def _joined(words: list[str]) -> bytes:
    """Words hold no markers."""
    return MARK.join(words).encode("utf-8", "surrogatepass")


def _name(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def decode(path: str, ids: np.ndarray) -> str:
    """What the library makes of these ids; none: an empty text."""
    return processor(path).decode(ids.astype(np.int64).tolist()) if len(ids) else ""


class Slice:
    """Texts of a slice as numbers of its different words, and the words' ids once they have come."""

    def __init__(self, path: str, buckets: int) -> None:
        self.path, self.buckets, self.index, self.texts, self.kept = path, buckets, {}, [], []
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] | None = None  # by bucket: how many ids a word has, and the ids

    def add(self, texts: Iterable[str], kept: pa.Array) -> None:
        index = self.index
        for t in texts:
            self.texts.append(np.array([index.setdefault(w, len(index)) for w in marked_words(t)], dtype=np.int32))
        self.kept.append(kept)

    def answer(self, bucket: int, name: bytes, lengths: np.ndarray, ids: np.ndarray) -> None:
        """The ids of a bucket's words. What was asked for other words than these isn't taken."""
        if self.found is None:
            self.words, self.found = bucketed(self.index, self.buckets), {}
        words = self.words.get(bucket, [])
        if _name(_joined(words)) == name:
            self.found[bucket] = (lengths, ids)

    def ids(self) -> Iterator[np.ndarray]:
        """The ids of each text, in order. Words without an answer are segmented here."""
        if self.found is None:
            self.words, self.found = bucketed(self.index, self.buckets), {}
        places, lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for bucket, words in self.words.items():
            n, flat = self.found[bucket] if bucket in self.found else _flat(segment(self.path, words))
            places.append(np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words)))
            lengths.append(n)
            ids.append(flat)
        place, length, flat = np.concatenate(places), np.concatenate(lengths).astype(np.int64), np.concatenate(ids)
        starts, sizes = np.zeros((2, len(place)), dtype=np.int64)
        starts[place], sizes[place] = np.cumsum(length) - length, length
        for at in self.texts:
            n = sizes[at]
            ends = np.cumsum(n)
            yield flat[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1])] if len(at) else flat[:0]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(len, ids), dtype=np.uint32, count=len(ids)), np.fromiter((i for x in ids for i in x), dtype=np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32), pa.int32()))


def _slices(docs: DataFrame, text: Column) -> tuple[Column, int]:
    """The slice of a row, as a long, and about how many there are: consecutive rows of an input partition.

    It follows from where a row lies in its partition. Were a partition read in another order the second time, words
    would be missing from a slice's answers and be segmented there: slower, with the same result.
    """
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    each = max(1, rows * SLICE_BYTES // max(size or 0, 1))
    at = F.monotonically_increasing_id()
    return (F.shiftright(at, 33) * PART_SLICES + F.least((at.bitwiseAND((1 << 33) - 1) / each).cast("long"), F.lit(PART_SLICES - 1))), rows // each


def encoded(docs: DataFrame, path: str, text_col: str = "text", end: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``ids`` (array of int): each row's whole text as the library encodes it.

    end: the model's end id follows. A null text counts as empty and has the end id alone. Columns of any name may be
    kept but ``ids``, which is replaced; null and repeated rows stay as they are. An empty table gives no rows.
    """
    made = {"ids": T.ArrayType(T.IntegerType())}
    return _encoded(docs, path, text_col, end, keep, made, lambda ids: [_lists(ids)])


def _encoded(docs: DataFrame, path: str, text_col: str, end: bool, keep: list[str] | None, made: dict[str, T.DataType], finish: Callable[[list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """The columns ``keep`` but those of ``made``, which ``finish`` makes of some rows' ids."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    of, count = _slices(docs, text)
    kept = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names))
    rows = docs.select(of.alias("slice"), text.alias("text"), kept.alias("kept"))
    buckets = partitions(docs.sparkSession)
    tasks = max(buckets, count)

    def wanted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The different words of each slice, by bucket."""
        now, words, zip_ = None, set(), zstandard.ZstdCompressor()

        def sent() -> Iterator[pa.RecordBatch]:
            by = bucketed(words, buckets)
            yield pa.RecordBatch.from_arrays([pa.array([now] * len(by), pa.int64()), pa.array(list(by), pa.int32()), pa.array([zip_.compress(_joined(w)) for w in by.values()], pa.binary())], ["slice", "bucket", "data"])

        for b in batches:
            for s, t in zip(b["slice"].to_pylist(), b["text"]):
                if s != now:
                    yield from sent()
                    now, words = s, set()
                words.update(marked_words(t.as_py()))
        yield from sent()

    def answered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each slice and bucket: the name of its words, how many ids each has, and the ids."""
        known: dict[str, list[int]] = {}
        zip_, unzip = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor()
        for b in batches:
            names, data = [], []
            for packed in b["data"]:
                joined = unzip.decompress(packed.as_py())
                words = joined.decode("utf-8", "surrogatepass").split(MARK)
                new = [w for w in words if w not in known]
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, words
                known.update(zip(new, segment(path, new)))
                lengths, ids = _flat([known[w] for w in words])
                names.append(_name(joined))
                data.append(zip_.compress(np.uint32(len(lengths)).tobytes() + lengths.tobytes() + ids.tobytes()))
            yield pa.RecordBatch.from_arrays([b["slice"], b["bucket"], pa.array(names, pa.binary()), pa.nulls(len(data), pa.list_(pa.int32())), pa.array(data, pa.binary())], ["slice", "bucket", "name", "sizes", "data"])

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one slice together, their texts compressed."""
        zip_ = zstandard.ZstdCompressor()
        for b in batches:
            slices, texts = b["slice"].to_numpy(), [memoryview(t.as_buffer()) for t in b["text"]]
            cuts, size = [0], 0
            for i, t in enumerate(texts):
                if size > PACK_BYTES or i and slices[i] != slices[i - 1]:
                    cuts.append(i)
                    size = 0
                size += len(t)
            ends = [*cuts[1:], b.num_rows]
            if not b.num_rows:
                continue
            at = pa.array([*cuts, b.num_rows], pa.int32())
            sizes = pa.ListArray.from_arrays(at, pa.array([len(t) for t in texts], pa.int32()))
            data = [zip_.compress(b"".join(texts[lo:hi])) for lo, hi in zip(cuts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(slices[cuts]), pa.ListArray.from_arrays(at, b["kept"]), sizes, pa.array(data, pa.binary())], ["slice", "kept", "sizes", "data"])

    kinds = {"slice": T.LongType(), "bucket": T.IntegerType(), "name": T.BinaryType(), "sizes": T.ArrayType(T.IntegerType()), "data": T.BinaryType()}
    asked = rows.select("slice", "text").mapInArrow(wanted, "slice long, bucket int, data binary")
    answers = asked.repartitionById(buckets, "bucket").mapInArrow(answered, T.StructType([T.StructField(c, k) for c, k in kinds.items()]))
    whole = rows.mapInArrow(packed, T.StructType([T.StructField("slice", T.LongType()), T.StructField("kept", T.ArrayType(rows.schema["kept"].dataType)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())]))
    both = whole.unionByName(answers, allowMissingColumns=True)
    # partitions, and the slices of a partition, have consecutive numbers
    place = F.pmod(F.floor(F.col("slice") / PART_SLICES) + F.col("slice") % PART_SLICES * 40_503, F.lit(tasks)).cast("int")
    dealt = both.repartitionById(tasks, place).select("slice", "bucket", "name", "sizes", "data", "kept").sortWithinPartitions("slice", F.asc_nulls_first("bucket"))
    last = np.array([processor(path).eos_id()] if end else [], dtype=np.int32)

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of a slice come first, then the answers."""
        now, of, unzip = None, None, zstandard.ZstdDecompressor()

        def told() -> Iterator[pa.RecordBatch]:
            if not of.kept:  # the rows were dealt out otherwise when they were read again
                return
            ids, rows, at = of.ids(), pa.concat_arrays(of.kept), 0
            while at < len(rows):
                out, size = [], 0
                while at + len(out) < len(rows) and size < OUT_BYTES:
                    out.append(np.concatenate((next(ids), last)))
                    size += 4 * len(out[-1])
                yield pa.RecordBatch.from_arrays([rows.slice(at, len(out)), *finish(out)], ["kept", *made])
                at += len(out)

        for b in batches:
            for i, (s, bucket) in enumerate(zip(b["slice"].to_pylist(), b["bucket"].to_pylist())):
                if s != now:
                    if of:
                        yield from told()
                    now, of = s, Slice(path, buckets)
                data = unzip.decompress(b["data"][i].as_py())
                if bucket is None:
                    ends = np.cumsum(b["sizes"][i].values.to_numpy()).tolist()
                    of.add((data[lo:hi].decode("utf-8", "surrogatepass") for lo, hi in zip([0, *ends], ends)), b["kept"][i].values)
                elif of.kept:
                    numbers = np.frombuffer(data, dtype=np.uint32)
                    n = 1 + int(numbers[0])
                    of.answer(bucket, b["name"][i].as_py(), numbers[1:n], numbers[n:].astype(np.int32))
        if of:
            yield from told()

    done = dealt.mapInArrow(joined, T.StructType([rows.schema["kept"], *(T.StructField(c, k) for c, k in made.items())]))
    return done.select(*(F.col(f"kept.`{c}`").alias(c) for c in names), *made)


def decoded(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the ids, if None) and ``text_col``: what the library makes of the ids.

    Null ids give an empty text; null elements and numbers that the model hasn't are left out. An empty table gives no rows.
    """
    names = [c for c in ([x for x in tokens.columns if x != ids_col] if keep is None else keep) if c != text_col]
    rows = tokens.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in names)).alias("kept"), F.col(f"`{ids_col}`").cast("array<long>").alias("ids"))
    size = len(processor(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for x in b["ids"]:
                ids = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0)
                ids = ids[(ids >= 0) & (ids < size)]  # a null is NaN here
                texts.append(decode(path, ids))
            yield pa.RecordBatch.from_arrays([b["kept"], pa.array(texts, pa.string())], ["kept", "text"])

    out = rows.mapInArrow(run, T.StructType([rows.schema["kept"], T.StructField("text", T.StringType())]))
    return out.select(*(F.col(f"kept.`{c}`").alias(c) for c in names), F.col("text").alias(text_col))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by one space), decoded_sha256 of every row.

    A null text counts as empty; null and repeated ids stay as they are. Other columns are not looked at. An empty table
    gives no rows.
    """
    made = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}

    def digests(ids: list[np.ndarray]) -> list[pa.Array]:
        listed = [hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]
        back = [hashlib.sha256(decode(path, x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
        return [pa.array(map(len, ids), pa.int64()), pa.array(listed), pa.array(back)]

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return _encoded(rows, path, "text", True, ["doc_id"], made, digests)

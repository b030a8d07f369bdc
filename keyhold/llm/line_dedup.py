"""Line dedup by content-defined chunks.

A text's lines are cut where a rolling hash over the last lines says so, and around each line of many words, so that
a run of lines that texts share is cut the same way wherever it stands. Each text is cut in some ways, by hashes of their
own, as a short run may hold a whole chunk of one and none of another. Chunks of several lines, and those long lines, that
occur again anywhere are compared as bytes, and only the first one stays. What lies around a chunk that goes is then held
against what lies around the one that stays, line by line, so that a shared run goes up to its edges.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyhold.llm.shared import Scratch, free, written

ROLL = 2  # lines under the rolling hash, and the fewest of a chunk that ends at a boundary
EVERY = 2  # one place in so many is a boundary
WORDS = 50  # a line of more words than these is a chunk of its own
WAYS = 4  # in which a text is cut
AROUND = 4  # lines on each side of a chunk that go with it
LINE = 12  # bytes of a line's digest
HOT_SHARE = 1000  # pieces with more than this share of all places are joined by broadcast: fewer than so many, none fills a task
_ODD = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def line_digests(lines: list[str]) -> list[bytes]:
    return [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=LINE).digest() for x in lines]


def chunks(lines: list[str], roll: int = ROLL, every: int = EVERY, words: int = WORDS, ways: int = WAYS) -> list[tuple[int, int]]:
    """(first, end) of each chunk that may go, counted over lines with text: of several lines, or one of more than ``words`` words.

    A boundary follows a line if the hash of it and the lines before it, ``roll`` in all, is a multiple of ``every``, and if
    it makes no chunk of fewer than ``roll`` lines. Long lines have boundaries on both sides. The ways of cutting look at
    different bits of the hash.
    """
    h = [int.from_bytes(x[:8], "little") for x in line_digests(lines)]
    long = [len(x) > 2 * words and len(x.split()) > words for x in lines]
    top, rolling, mixed = pow(_ODD, roll, 1 << 64), 0, []
    for i, x in enumerate(h):
        rolling = (rolling * _ODD + x - (h[i - roll] * top if i >= roll else 0)) & _ALL
        mixed.append((rolling ^ rolling >> 29) * _ODD & _ALL)
    out = {(i, i + 1) for i, x in enumerate(long) if x}
    for way in range(ways):
        first, shift, least = 0, 48 - 12 * way, 4096 // every
        for i, x in enumerate(mixed):
            if long[i]:
                out.add((first, i))
                first = i + 1
            elif i + 1 - first >= roll and x >> shift & 4095 < least:
                out.add((first, i + 1))
                first = i + 1
        out.add((first, len(lines)))
    return sorted((lo, hi) for lo, hi in out if hi - lo > 1 or hi > lo and long[lo])


def _digest(content: str) -> bytes:
    return hashlib.sha256(content.encode("utf-8", "surrogatepass")).digest()


class _Text:
    """A text's lines with text, where they stand, and its chunks (digest, first, end), counted over these."""

    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        self.at = [i for i, x in enumerate(self.lines) if x.strip()]
        self.full = [self.lines[i] for i in self.at]
        self.chunks = [(_digest(self.content(lo, hi)), lo, hi) for lo, hi in chunks(self.full)]

    def content(self, lo: int, hi: int) -> str:
        return "\n".join(self.lines[self.at[lo] : self.at[hi - 1] + 1])

    def around(self, lo: int, hi: int) -> tuple[bytes, bytes]:
        """The digests of the lines before a chunk, nearest first, and after it."""
        return b"".join(line_digests(self.full[max(0, lo - AROUND) : lo][::-1])), b"".join(line_digests(self.full[hi : hi + AROUND]))

    def shared(self, lo: int, hi: int, before: bytes, after: bytes) -> tuple[int, int]:
        """The chunk with those lines before and after it that are like these."""
        for x, d in zip(self.full[max(0, lo - AROUND) : lo][::-1], _split(before)):
            if line_digests([x]) != [d]:
                break
            lo -= 1
        for x, d in zip(self.full[hi : hi + AROUND], _split(after)):
            if line_digests([x]) != [d]:
                break
            hi += 1
        return lo, hi


def _split(digests: bytes) -> Iterator[bytes]:
    return (digests[i : i + LINE] for i in range(0, len(digests), LINE))


def _places(rows: DataFrame) -> DataFrame:
    """(id, key, digest, copies, before, after) of each chunk, once a row; the lines around it are those of its first place there."""
    kinds = {"digest": pa.binary(), "copies": pa.int64(), "before": pa.binary(), "after": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, cols = [], [[] for _ in kinds]
            for i, text in enumerate(b["text"].to_pylist()):
                of = _Text(text or "")
                copies, first = Counter(d for d, _, _ in of.chunks), {}
                for d, lo, hi in of.chunks:
                    first.setdefault(d, (lo, hi))
                for d, n in copies.items():
                    doc.append(i)
                    for c, x in zip(cols, (d, n, *of.around(*first[d]))):
                        c.append(x)
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([b["id"].take(at), b["key"].take(at), *(pa.array(c, k) for c, k in zip(cols, kinds.values()))], ["id", "key", *kinds])

    return rows.select("id", "key", "text").mapInArrow(run, "id long, key long, digest binary, copies long, before binary, after binary")


def _hits(places: DataFrame) -> DataFrame:
    """(id, key, digest, other) of each place of a chunk that occurs more than once. other: what stands around it in the row
    that owns it, the one with the smallest id (nulls last) and then key that has it; null: this is that row."""
    owner = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "before", "after")).alias("owner")
    shared = written(places.groupBy("digest").agg(owner, F.sum("copies").alias("copies"), F.count("*").alias("places")).filter("copies > 1"), "shared")
    most = max(1, (shared.agg(F.sum("places")).first()[0] or 0) // HOT_SHARE)
    hot, cold = (shared.filter(x).select("digest", "owner") for x in (f"places > {most}", f"places <= {most}"))
    near = places.join(F.broadcast(hot), "digest")
    far = places.join(F.broadcast(hot), "digest", "left_anti").join(cold, "digest")
    own = F.col("id").eqNullSafe(F.col("owner.id")) & (F.col("key") == F.col("owner.key"))
    return near.unionByName(far).select("id", "key", "digest", F.when(~own, F.struct("digest", "owner.before", "owner.after")).alias("other"))


def _clashes(joined: DataFrame, shared_col: str) -> list[bytes]:
    """The digests of repeated chunks that stand for two contents, from rows with text and ``shared_col``. Digest and content
    decide together, so equal means equal byte by byte; copies are combined in the map task, so a chunk that many rows share
    moves once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, content = [], []
            for text, shared in zip(b["text"].to_pylist(), b["shared"].to_pylist()):
                shared, of = set(shared), _Text(text)
                own = {d: of.content(lo, hi) for d, lo, hi in of.chunks if d in shared} if shared else {}
                digest += own.keys()
                content += own.values()
            for lo in range(0, len(digest), 5_000):
                yield pa.RecordBatch.from_arrays([pa.array(digest[lo : lo + 5_000], pa.binary()), pa.array(content[lo : lo + 5_000], pa.string())], ["digest", "content"])

    rows = joined.select("text", F.col(shared_col).alias("shared")).filter("shared IS NOT NULL AND text IS NOT NULL")
    same = rows.mapInArrow(run, "digest binary, content string").distinct()
    return [bytes(r.digest) for r in same.groupBy("digest").count().filter("count > 1").collect()]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with the text without repeated chunks, n_lines (as it was), n_removed (lines) and
    spans (of the removed lines: first, end).

    Of equal chunks (``chunks``), the one in the row with the smallest id stays, there the first. The others go, with up to
    ``AROUND`` lines on each side that stand around the one that stays too, and the blank lines between. Each line that goes
    is in a row with a smaller id, or further up in its own. Lines that are in no such run stay even if they repeat. A null
    text stays null and has no lines; an empty one has one empty line. A row with a null id gives way to any other. Rows
    with one id, or none, are told apart by a hash of their texts, whose smallest stays; those that repeat both id and text
    are one row here, and keep or lose the same lines. Columns named n_lines, n_removed and spans are replaced. An empty
    table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "spans")]
    at, mark, same, lost_ = (free(docs, c) for c in ("place", "mark", "shared", "lost"))
    name, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    key = F.xxhash64(name, text)
    rows = docs.select(name.alias("id"), key.alias("key"), text.alias("text"))
    # copies in other rows than the owner's; within a row, repeats are seen when its text is cut
    with Scratch(docs.sparkSession) as scratch:
        hits = _hits(written(_places(rows), "places"))
        lost = scratch.keep(hits.groupBy("id", "key").agg(F.collect_set("digest").alias("shared"), F.collect_list("other").alias("lost")), "lost")
    lost = lost.withColumnsRenamed({"id": at, "key": mark, "shared": same, "lost": lost_})
    joined = docs.select(*(F.col(f"`{c}`") for c in own)).join(lost, (key == F.col(mark)) & name.eqNullSafe(F.col(at)), "left").drop(at, mark)
    clash = set(_clashes(joined.select(text.alias("text"), same), same))  # neither is ever removed
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*[docs.schema[c] for c in own], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
        for b in batches:
            out = [_cut(t, set(s or ()) - clash, {x["digest"]: (x["before"], x["after"]) for x in o or ()}) for t, s, o in zip(b[text_col].to_pylist(), b[same].to_pylist(), b[lost_].to_pylist())]
            text, *rest = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*[text if c == text_col else b[c] for c in own], *rest], [*own, "n_lines", "n_removed", "spans"])

    return joined.mapInArrow(run, schema)


def _cut(text: str | None, shared: set[bytes], other: dict[bytes, tuple[bytes, bytes]]) -> tuple[str | None, int, int, list[tuple[int, int]]]:
    if text is None:
        return None, 0, 0, []
    if not shared:
        return text, text.count("\n") + 1, 0, []
    of, seen, gone = _Text(text), {}, set()
    for d, lo, hi in of.chunks:
        if d not in shared:
            continue
        if d in other:
            lo, hi = of.shared(lo, hi, *other[d])
        elif seen.setdefault(d, hi) > lo:  # the first copy, or one that overlaps it
            continue
        gone.update(range(of.at[lo], of.at[hi - 1] + 1))
    spans: list[tuple[int, int]] = []
    for i in sorted(gone):
        if spans and spans[-1][1] == i:
            spans[-1] = spans[-1][0], i + 1
        else:
            spans.append((i, i + 1))
    return "\n".join(x for i, x in enumerate(of.lines) if i not in gone), len(of.lines), len(gone), spans

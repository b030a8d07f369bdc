"""Packing documents into windows of a fixed length by minimum bin slack.

A document is cut into whole windows and a rest. What is left is a multiset of lengths of at most one window: its
histogram is small whatever the corpus, so the driver plans on that alone, and each piece then finds its place from its
rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyhold.llm.shared import free, released, written
from keyhold.llm.tokens import Encoder, closed, encoder, slices

CAPACITY = 4096
TOGETHER = 1 << 20  # pieces of one length that are ranked in one task
Pattern = tuple[int, int, list[tuple[int, int]]]


def fill(room: int, counts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(length, how many) of the multiset closest to ``room`` from below; counts: (length, available), longest first.

    The sums that can be reached are the set bits of one integer; each length is added in portions of 1, 2, 4 and so on,
    and the way back through the portions gives the counts.
    """
    full, reach, mask, steps = 1 << room, 1, (1 << room + 1) - 1, []
    for length, n in counts:
        if length > room:
            continue
        n, k = min(n, room // length), 1
        while n and not reach & full:
            k = min(k, n)
            steps.append((length, k, reach))
            reach |= reach << length * k & mask
            n, k = n - k, k * 2
        if reach & full:
            break
    at, out = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + k
            at -= length * k
    return sorted(out.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """(first window, windows, [(length, how many a window)]): each window takes the longest piece left and the best fill.

    A fill is used for as many windows as there are pieces for, so the plan's length follows the number of different
    lengths and not that of pieces.
    """
    left, out, first = dict(sorted(counts.items(), reverse=True)), [], 0
    while left:
        longest = next(iter(left))
        rest = [(k, n - (k == longest)) for k, n in left.items()]
        chosen = dict(fill(capacity - longest, [x for x in rest if x[1]]))
        chosen[longest] = chosen.get(longest, 0) + 1
        copies = min(left[k] // n for k, n in chosen.items())
        out.append((first, copies, sorted(chosen.items(), reverse=True)))
        first += copies
        for k, n in chosen.items():
            left[k] -= n * copies
            if not left[k]:
                del left[k]
    return out


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """The plan as columns, a row for each length of each pattern, sorted by (length, rank): pieces ``rank`` on go there."""
    taken: dict[int, int] = {}
    rows = []
    for first, copies, chosen in patterns:
        offset = 0
        for length, n in chosen:
            rank = taken.get(length, 0)
            rows.append((length, rank, n, first, offset))
            taken[length] = rank + n * copies
            offset += length * n
    cols = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "first", "offset"), cols.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY, together: int = TOGETHER) -> DataFrame:
    """The pieces with sequence_id and offset (longs): where each lies. Windows count from 0, and are gapless.

    pieces: doc_id, start, length (1 to capacity, else ValueError) and any other columns, of which sequence_id and offset
    are replaced. Pieces that are equal in all columns get a place each; nulls in other columns are kept. An empty table
    gives no rows. together: about how many pieces of one length are ranked in one task.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    place_, salt_, rank_ = (free(pieces, c) for c in ("place", "salt", "rank"))
    pieces = written(pieces.select(*[F.col(f"`{c}`") for c in own]).withColumn(place_, F.monotonically_increasing_id()), "pieces")
    total = np.zeros(capacity + 1, dtype=np.int64)
    for k, n in pieces.groupBy("length").count().filter(f"length BETWEEN 1 AND {capacity}").collect():  # at most capacity rows
        total[k] = n
    if not (odd := pieces.filter(f"length IS NULL OR length NOT BETWEEN 1 AND {capacity}").select("length").limit(1)).isEmpty():
        raise ValueError(f"a piece of {odd.first()[0]}; lengths of 1 to {capacity} can be packed")
    # each length has as many salts as it has portions of ``together`` pieces: full windows are most of a corpus
    salts = np.maximum(1, -(-total // together))
    base = np.cumsum(salts) - salts
    many = F.element_at(F.lit(salts.tolist()), (F.col("length") + 1).cast("int"))
    salted = pieces.withColumn(salt_, F.pmod(F.xxhash64(place_), many))
    before = np.zeros(int(salts.sum()) + 1, dtype=np.int64)
    for k, s, n in salted.groupBy("length", salt_).agg(F.count("*")).collect():  # at most capacity rows, and one for each ``together`` pieces
        before[base[k] + s + 1] = n
    before = np.cumsum(before)
    before = before[:-1] - before[np.repeat(base, salts)]
    at = slots(plan({int(k): int(total[k]) for k in np.flatnonzero(total)}, capacity))
    key = at["length"] << 44 | at["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, salt, rank = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", salt_, rank_))
            rank = rank - 1 + before[base[length] + salt]
            i = np.searchsorted(key, length << 44 | rank, side="right") - 1
            nth = rank - at["rank"][i]
            sequence = at["first"][i] + nth // at["each"][i]
            offset = at["offset"][i] + nth % at["each"][i] * length
            yield pa.RecordBatch.from_arrays([*[b[c] for c in own], pa.array(sequence), pa.array(offset)], [*own, "sequence_id", "offset"])

    ranked = salted.withColumn(rank_, F.row_number().over(Window.partitionBy("length", salt_).orderBy(place_)).cast("long"))
    places = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]
    return ranked.drop(place_).mapInArrow(place, T.StructType([*[pieces.schema[c] for c in own], *places]))


def cut(docs: DataFrame, tokenize: Callable[[], Encoder], end_id: int, capacity: int = CAPACITY, text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids_crc32, ids (binary, little-endian uint32): whole windows and a rest of each row.

    tokenize makes the encoder in a worker. ids: whether the ids go along. A null text counts as empty: its end id is its
    one piece. A null or repeated doc_id stays as it is. An empty table gives no rows.
    """
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenize()
        for b in batches:
            for lo, hi in slices(b["text"]):
                tokens, ends = closed(*enc.batch(b["text"].slice(lo, hi - lo).to_pylist()), end_id)
                raw, size = memoryview(tokens.astype("<u4", copy=False).tobytes()), np.diff(ends, prepend=0)
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(size[doc] - start, capacity)
                first = 4 * ((ends - size)[doc] + start)
                parts = [raw[i:j] for i, j in zip(first.tolist(), (first + 4 * length).tolist())]
                cols = [b["doc_id"].slice(lo, hi - lo).take(pa.array(doc)), *map(pa.array, (start, length, size[doc])), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(list(map(bytes, parts)), pa.binary())] if ids else [])], names)
        released()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids_crc32 long" + (", ids binary" if ids else ""))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of every row; see :func:`cut` for null
    texts, null or repeated ids and empty tables. Ids are made once and not moved."""
    pieces = cut(docs, lambda: encoder(tokenizer), end_id, capacity, ids=False)
    return pack(pieces, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def windows(placed: DataFrame, pad_id: int, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids (array of long): the windows themselves, from pieces with ids, sequence_id and offset.

    A window shorter than ``capacity`` is padded to it, unless its length is a power of two. No pieces: no rows.
    """
    schema = "sequence_id long, ids array<long>"

    def build(group) -> object:
        import pandas as pd

        ids = np.concatenate([np.frombuffer(x, "<u4") for x in group.sort_values("offset")["ids"]]).astype(np.int64)
        if len(ids) & len(ids) - 1:
            ids = np.concatenate((ids, np.full(capacity - len(ids), pad_id)))
        return pd.DataFrame({"sequence_id": [group["sequence_id"].iloc[0]], "ids": [ids]})

    return placed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(build, schema)

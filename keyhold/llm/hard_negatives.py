"""Hard negatives by inner product, with a pivot table.

Vectors are lengthened by one component so that all rows have one norm, M, and anchors get a zero there: then the squared
distance of anchor and row is |anchor|^2 + M^2 - 2 * score, and the triangle inequality over the stored distances to a few
pivots brackets each score. Rows lie in slices, by nearest pivot and distance to it; anchors are sent only to groups of
slices whose bracket reaches what they look for, and within a slice only rows whose own bracket does are scored exactly.

Anchors are a stated share of the rows, and each is held against the rows of its slices, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyhold.llm.shared import Scratch, partitions, written

PIVOTS = 8
SAMPLE = 1_024  # rows, those of the least hash, among which the pivots are chosen
SLICE_ROWS, LEAST_ROWS = 65_536, 512  # rows of a slice, at most on average, and where there are more tasks than needed
GROUPS = 4_096  # groups of slices that have a bracket of their own: so many numbers times 16 go to each task
NORM = 1 << 55  # squared norm from which a vector takes no part: 100 times a score must fit a long
EXACT = 1 << 53  # below it, sums of products are exact in double precision
CHUNK = 256  # rows that are scored at a time while the best are sought

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(points: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x becomes floor(scale * x); a row's score is its inner product with the anchor. Higher scores come first,
    ties by smaller id. An anchor's positives are its first ``positives`` other rows of its label; for each, its first
    ``negatives`` rows of other labels are returned for which low * positive <= 100 * score <= high * positive.

    anchor: a condition over the columns of ``points``; null counts as false. Rows with a null id, label or vector, or a
    null or non-finite component take no part, nor do those whose scaled vector has a squared norm of 2^55 or more. Rows of
    an anchor's own id are neither its positives nor its negatives; otherwise repeated rows each count. Vectors of
    different lengths have no score. Other columns are not looked at. An empty table gives no rows.
    """
    spark = points.sparkSession
    label = F.col(f"`{label_col}`") if isinstance(label_col, str) else label_col
    with Scratch(spark) as scratch:
        rows = points.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
        scaled = written(_scaled(rows.dropna(subset=["id", "label", "vector"]), scale), "scaled")
        count = scaled.count()
        if not count:
            return scratch.keep(spark.createDataFrame([], RESULT), "negatives")
        pivots = _pivots(scaled)
        slices = max(math.ceil(count / SLICE_ROWS), min(partitions(spark), math.ceil(count / LEAST_ROWS)))
        table = written(_table(scaled, pivots, slices), "pivot-table")
        scratch.drop(scaled)
        per = math.ceil(slices / GROUPS)
        brackets = _brackets(table, len(pivots.points), per)
        anchors = table.filter("anchor").select("id", "row", "label", "vector", "norm", "slice")

        # the best of an anchor's own slice bound what others must reach
        home = _searched(table, anchors.withColumns({"least": F.lit(None).cast("long"), "known": F.lit(None).cast(KNOWN)}), pivots, slices, _Best(positives))
        home = home.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= positives).select("row", "least")
        seeking = anchors.drop("slice").join(home, "row", "left").withColumn("known", F.lit(None).cast(KNOWN))
        found = _searched(table, _sent(seeking, pivots, brackets, per, slices), pivots, slices, _Best(positives))
        first = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc("other")))
        best = written(found.withColumn("rank", first).filter(F.col("rank") <= positives), "positives")
        known = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("known"))
        seeking = anchors.drop("slice").join(known, "row").withColumn("least", F.lit(None).cast("long"))
        found = _searched(table, _sent(seeking, pivots, brackets, per, slices, low, high), pivots, slices, _Window(negatives, low, high))
        at = F.row_number().over(Window.partitionBy("row", "which").orderBy(F.desc("score"), F.asc("other")))
        ranked = found.withColumn("rank", at).filter(F.col("rank") <= negatives)
        told = best.select("row", F.col("rank").alias("which"), F.col("id").alias("anchor_id"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
        out = ranked.select("row", "which", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score")).join(told, ["row", "which"])
        return scratch.keep(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")


KNOWN = "array<struct<rank:int,other:long,score:long>>"


def _scaled(rows: DataFrame, scale: int) -> DataFrame:
    """(id, label, anchor, row, vector (binary, 32-bit), norm, length) of the rows that take part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b["vector"].value_lengths().to_numpy()
            x = np.floor(b["vector"].flatten().to_numpy(zero_copy_only=False) * float(scale))
            ends = np.cumsum(lengths)
            fits = np.abs(x) < 1 << 28  # false for what isn't finite
            bad = np.concatenate(([0], np.cumsum(~fits)))
            whole = np.where(fits, x, 0).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(whole * whole)))  # may wrap around; differences don't
            norm = upto[ends] - upto[ends - lengths]
            # a norm that wraps around is also too large in floating point
            rough = np.concatenate(([0], np.cumsum(np.where(fits, x, 0) ** 2)))
            at = np.flatnonzero((bad[ends] == bad[ends - lengths]) & (norm >= 0) & (norm < NORM) & (rough[ends] - rough[ends - lengths] < 2.0 * NORM))
            small = whole.astype("<i4")
            vectors = [small[e - n : e].tobytes() for e, n in zip(ends[at].tolist(), lengths[at].tolist())]
            kept = b.select(["id", "label", "anchor"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(vectors, pa.binary()), pa.array(norm[at], pa.int64()), pa.array(lengths[at], pa.int32())], ["id", "label", "anchor", "vector", "norm", "length"])

    return rows.mapInArrow(run, "id long, label string, anchor boolean, vector binary, norm long, length int").withColumn("row", F.monotonically_increasing_id())


@dataclass
class Pivots:
    """length: of the vectors that have distances; others are compared without a bracket."""

    length: int
    points: np.ndarray
    square: float  # of the norm that lengthened rows have
    rest: np.ndarray = field(init=False)  # the pivots' last components

    def __post_init__(self) -> None:
        self.rest = np.sqrt(np.maximum(0, self.square - (self.points**2).sum(axis=1)))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(0, self.square - (x**2).sum(axis=1)))
        return np.sqrt(np.maximum(0, 2 * self.square - 2 * (x @ self.points.T + np.outer(last, self.rest))))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + self.square - 2 * x @ self.points.T))

    def scores(self, norm: float, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score at these distances, with room for rounding."""
        room = 1 + 1e-6 * (norm + self.square)
        return (norm + self.square - far**2) / 2 - room, (norm + self.square - near**2) / 2 + room


def _pivots(scaled: DataFrame) -> Pivots:
    """Far points of a bounded sample: each next one is farthest from those chosen."""
    sample = scaled.select("id", "vector", "length").orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).collect()
    lengths = [r.length for r in sample]
    length = max(set(lengths), key=lambda n: (lengths.count(n), n))
    square = scaled.filter(F.col("length") == length).agg(F.max("norm")).first()[0]
    x = np.array([np.frombuffer(r.vector, dtype="<i4") for r in sample if r.length == length], dtype=float)
    whole = np.hstack((x, np.sqrt(np.maximum(0, square - (x**2).sum(axis=1)))[:, None]))
    chosen, far = [0], np.linalg.norm(whole - whole[0], axis=1)
    while len(chosen) < min(PIVOTS, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(whole - whole[chosen[-1]], axis=1))
    return Pivots(length, x[chosen], float(square))


def _matrix(vectors: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype="<i4").reshape(len(vectors), length).astype(float)


def _table(scaled: DataFrame, pivots: Pivots, slices: int) -> DataFrame:
    """The rows with ``far`` (distances to the pivots; null for vectors of another length) and ``slice``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, vectors = b["length"].to_numpy(), b["vector"].to_pylist()
            far: list[np.ndarray | None] = [None] * len(vectors)
            near, least = np.full(len(vectors), -1, dtype=np.int32), np.zeros(len(vectors))
            if len(at := np.flatnonzero(lengths == pivots.length)):
                d = pivots.of_rows(_matrix([vectors[i] for i in at], pivots.length))
                near[at], least[at] = d.argmin(axis=1), d.min(axis=1)
                for i, row in zip(at.tolist(), d):
                    far[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far, pa.list_(pa.float64())), pa.array(near), pa.array(least)], [*b.schema.names, "far", "near", "least"])

    kinds = {"far": T.ArrayType(T.DoubleType()), "near": T.IntegerType(), "least": T.DoubleType()}
    out = scaled.mapInArrow(run, T.StructType([*scaled.schema.fields, *(T.StructField(c, k) for c, k in kinds.items())]))
    # the hash splits equal vectors
    return out.repartitionByRange(slices, "near", "least", F.xxhash64("row")).withColumn("slice", F.spark_partition_id()).drop("near", "least")


def _brackets(table: DataFrame, count: int, per: int) -> dict[int, tuple[np.ndarray, np.ndarray] | None]:
    """For each group of slices, the least and largest distance to each pivot; None where rows have none. At most ``GROUPS`` entries."""
    ends = [x for i in range(count) for x in (F.min(F.col("far")[i]).alias(f"lo{i}"), F.max(F.col("far")[i]).alias(f"hi{i}"))]
    out = {}
    for r in table.groupBy(F.floor(F.col("slice") / per).alias("group")).agg(F.count_if(F.col("far").isNull()).alias("without"), *ends).collect():
        out[r.group] = None if r.without else (np.array([r[f"lo{i}"] for i in range(count)]), np.array([r[f"hi{i}"] for i in range(count)]))
    return out


def _sent(anchors: DataFrame, pivots: Pivots, brackets: dict, per: int, slices: int, low: int = 0, high: int = 100) -> DataFrame:
    """Each anchor once for each slice that may hold what it looks for: scores of ``least`` or more, or those that make negatives."""
    schema = T.StructType([*anchors.schema.fields, T.StructField("slice", T.IntegerType())])
    groups = sorted(brackets)
    none = np.array([brackets[g] is None for g in groups])
    wide = np.zeros(len(pivots.points)), np.full(len(pivots.points), np.inf)
    lo, hi = (np.array([(brackets[g] or wide)[i] for g in groups]) for i in (0, 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = np.frombuffer(b["vector"][i].as_py(), dtype="<i4").astype(float)
                bottom, top = _wanted(b["least"][i].as_py(), b["known"][i].as_py(), low, high)
                reach = np.ones(len(groups), dtype=bool)
                if len(x) == pivots.length:
                    d = pivots.of_anchors(x[None])[0]
                    near, far = np.maximum(0, np.maximum(lo - d, d - hi)).max(axis=1), (d + hi).min(axis=1)
                    worst, best = pivots.scores(float((x**2).sum()), near, far)
                    reach = none | (best >= bottom) & (worst <= top)
                to = [s for g in np.array(groups)[reach].tolist() for s in range(g * per, min(slices, (g + 1) * per))]
                yield pa.RecordBatch.from_arrays([*b.take(pa.array([i] * len(to), pa.int64())).columns, pa.array(to, pa.int32())], names=[f.name for f in schema.fields])

    return anchors.mapInArrow(run, schema)


def _wanted(least: int | None, known: list[dict] | None, low: int, high: int) -> tuple[float, float]:
    """The scores that an anchor looks for."""
    if known is None:
        return (-np.inf if least is None else least), np.inf
    scores = [k["score"] for k in known]
    return min(low * s for s in scores) / 100 - 1, max(high * s for s in scores) / 100 + 1


@dataclass
class _Best:
    """The ``most`` best rows of the anchor's label."""

    most: int

    def __call__(self, rows: _Rows, at: np.ndarray, same: np.ndarray, least: int | None, known: None, score) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        at = at[same[at]]
        worst, best = rows.bracket(at)
        if least is not None:
            at, best = at[best >= least], best[best >= least]
        order = np.argsort(-best, kind="stable")
        found, scores, bound = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), -np.inf
        for i in range(0, len(order), CHUNK):
            part = order[i : i + CHUNK]
            if best[part[0]] < bound:
                break
            found, scores = np.concatenate((found, at[part])), np.concatenate((scores, score(at[part])))
            keep = np.lexsort((rows.ids[found], -scores))[: self.most]
            found, scores = found[keep], scores[keep]
            if len(found) == self.most:
                bound = scores[-1]
        yield 0, found, scores


@dataclass
class _Window:
    """For each positive, the ``most`` best rows of other labels whose scores lie in its window."""

    most: int
    low: int
    high: int

    def __call__(self, rows: _Rows, at: np.ndarray, same: np.ndarray, least: None, known: list[dict], score) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        at = at[~same[at]]
        bottom, top = _wanted(None, known, self.low, self.high)
        worst, best = rows.bracket(at)
        at = at[(best >= bottom) & (worst <= top)]
        scores = score(at)
        order = np.lexsort((rows.ids[at], -scores))
        at, scores = at[order], scores[order]
        for k in known:
            fits = np.flatnonzero((self.low * k["score"] <= 100 * scores) & (100 * scores <= self.high * k["score"]))[: self.most]
            yield k["rank"], at[fits], scores[fits]


class _Rows:
    """The rows of a slice, by length of vector; and the anchor that is held against them."""

    def __init__(self, batches: list[pa.RecordBatch], pivots: Pivots) -> None:
        whole = pa.Table.from_batches(batches)
        self.ids, self.rows, self.labels = whole["id"].to_numpy(), whole["row"].to_numpy(), whole["label"].to_numpy()
        vectors = whole["vector"].to_pylist()
        lengths = np.array([len(v) // 4 for v in vectors])
        self.exact = (whole["norm"].to_numpy().max() if len(vectors) else 0) < EXACT
        self.at = {n: np.flatnonzero(lengths == n) for n in set(lengths.tolist())}
        self.place = np.zeros(len(vectors), dtype=np.int64)
        self.vectors = {}
        for n, at in self.at.items():
            self.place[at] = np.arange(len(at))
            self.vectors[n] = _matrix([vectors[i] for i in at], n)
        self.pivots = pivots
        self.far = np.array(whole["far"].take(pa.array(self.at[pivots.length], pa.int64())).to_pylist()) if pivots.length in self.at else None
        self.d: np.ndarray | None = None
        self.norm = 0.0

    def bracket(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that these rows may have with the anchor."""
        if self.d is None or not len(at):
            return np.full(len(at), -np.inf), np.full(len(at), np.inf)
        far = self.far[self.place[at]]
        return self.pivots.scores(self.norm, np.abs(far - self.d).max(axis=1), (far + self.d).min(axis=1))

    def answers(self, b: pa.RecordBatch, i: int, how: _Best | _Window) -> Iterator[tuple[int, int, int]]:
        """(which, other id, score) for the anchor in row i."""
        x = np.frombuffer(b["vector"][i].as_py(), dtype="<i4").astype(float)
        at = self.at.get(len(x))
        if at is None:
            return
        self.norm = float((x**2).sum())
        self.d = self.pivots.of_anchors(x[None])[0] if len(x) == self.pivots.length else None
        of = self.vectors[len(x)]
        exact = self.exact and self.norm < EXACT

        def score(at: np.ndarray) -> np.ndarray:
            some = of[self.place[at]]
            return (some @ x).astype(np.int64) if exact else some.astype(np.int64) @ x.astype(np.int64)

        others = at[self.ids[at] != b["id"][i].as_py()]
        for which, found, scores in how(self, others, self.labels == b["label"][i].as_py(), b["least"][i].as_py(), b["known"][i].as_py(), score):
            yield from ((which, int(self.ids[f]), int(s)) for f, s in zip(found, scores))


def _searched(table: DataFrame, anchors: DataFrame, pivots: Pivots, slices: int, how: _Best | _Window) -> DataFrame:
    """(id, row, which, other, score): what each anchor finds in each slice that it was sent to.

    A task takes the rows of a slice, and then the slice's anchors pass by.
    """
    held = table.select("slice", F.lit(False).alias("asks"), "id", "row", "label", "vector", "norm", "far")
    asks = anchors.select("slice", F.lit(True).alias("asks"), "id", "row", "label", "vector", "norm", "least", "known")
    both = held.unionByName(asks, allowMissingColumns=True)
    dealt = both.repartitionById(slices, F.col("slice").cast("int")).sortWithinPartitions("slice", "asks")
    names = ["id", "row", "which", "other", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, rows = None, [], None
        for b in batches:
            slices_, asks = b["slice"].to_numpy(), b["asks"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((slices_[1:] != slices_[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), b.num_rows]
            out: list[tuple] = []
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if slices_[lo] != now:
                    now, waiting, rows = slices_[lo], [], None
                if not asks[lo]:
                    waiting.append(b.slice(lo, hi - lo))
                    continue
                if waiting and rows is None:
                    rows, waiting = _Rows(waiting, pivots), []
                if rows is not None:
                    for i in range(lo, hi):
                        out.extend((b["id"][i].as_py(), b["row"][i].as_py(), *x) for x in rows.answers(b, i, how))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int32() if c == "which" else pa.int64()) for j, c in enumerate(names)], names)

    return dealt.mapInArrow(run, "id long, row long, which int, other long, score long")

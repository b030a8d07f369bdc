"""Near-duplicate vectors by sorted projection passes.

A pass gives each vector a key, the signs of its products with random directions in a row, and sorts by it: vectors at a
small angle mostly agree in their first signs and so come to lie close together. What vectors have in common, their mean and
the few directions in which they vary most, is taken off first, so that signs split them evenly; how many passes are
needed follows from what is left of them. Each is compared with a bounded number of neighbours, in double precision.
Where more vectors share their first signs than that, as in a cluster, all of them are compared with each other, in
blocks. The pairs found in all passes are joined to components. Links within a component are then counted exactly, in blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyhold.llm.components import components
from keyhold.llm.shared import Scratch, free, partitions, written

COSINE = 0.95
BITS = 64  # signs of a key
NEIGHBOURS = 32  # that follow a vector in the order and are compared with it
MISS = 0.002  # share of pairs at the threshold itself that may share their first signs in no pass; windows meet most of these too
CROWD = 8  # times the neighbours: more vectors than this with the same first signs are compared in blocks
SAMPLE = 4_096  # vectors, those of the least hash, from which the mean and the leading directions are taken
LEADING, ABOVE = 8, 4  # directions at most that are taken off, and how far their variance must be above the average
LOW = 0.1  # share of the vectors of which less may be left than the number of passes is made for
APART = 0.4  # least cosine of what is left of a pair that the number of passes is made for
AT_ONCE = 4  # passes in one shuffle
CROWD_BLOCK = 1024  # vectors of a crowded prefix that are compared with each other at a time
HOT_SHARE = 1000  # prefixes with more than this share of a pass are joined by broadcast
BLOCK = 128  # vectors of a component that are counted against each other at a time


def prefix_bits(vectors: int, neighbours: int = NEIGHBOURS) -> int:
    """The first signs whose agreement makes a pair meet: as many as leave ``neighbours`` vectors each, were they even."""
    return min(BITS, max(0, math.ceil(math.log2(max(1, vectors) / neighbours))))


@dataclass(frozen=True)
class Common:
    """What vectors of a length have in common. rest: the squared length of what is left of all but ``LOW`` of them."""

    mean: np.ndarray
    leading: np.ndarray
    rest: float

    def cosine(self, cosine: float) -> float:
        """The cosine of what is left of two vectors of this cosine: their difference stays, if it has no part in the leading directions."""
        return max(APART, 1 - (1 - cosine) / max(self.rest, 1e-9))


def common(unit: np.ndarray) -> Common:
    mean = unit.mean(axis=0)
    left = unit - mean
    if len(unit) < 64:  # too few to tell directions from chance
        return Common(np.zeros_like(mean), np.zeros((0, len(mean))), 1.0)
    variance, directions = np.linalg.eigh(left.T @ left / len(left))
    lead = directions[:, variance > ABOVE * variance.sum() / len(mean)].T[::-1][:LEADING]
    left = left - left @ lead.T @ lead
    return Common(mean, lead, float(np.quantile((left**2).sum(axis=1), LOW)))


def commons(nodes: DataFrame, kind: str) -> dict[int, Common]:
    """By length in bytes, from ``SAMPLE`` vectors in all; lengths that none of these has aren't there."""
    raw = [r.vec for r in nodes.select("vec").orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).collect()]
    return {n: common(units([r for r in raw if len(r) == n], kind)) for n in sorted({len(r) for r in raw})}


def passes(vectors: int, cosine: float = COSINE, neighbours: int = NEIGHBOURS, miss: float = MISS) -> int:
    """So many that a pair at the threshold shares its first signs in none of them with probability ``miss``, whatever the
    number of vectors.

    Such a pair lies close together in the pass: mostly in the window, or where the prefix is crowded, in a block.
    """
    agree = 1 - math.acos(cosine) / math.pi
    met = agree ** prefix_bits(vectors, neighbours)
    return 1 if met >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-met)))


def _valid(x: np.ndarray) -> bool:
    return len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())


def described(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, digest, vec) of each row: sha256 and bytes of a vector of finite numbers that isn't zero, null otherwise."""
    wide = isinstance(table.schema[vector_col].dataType.elementType, T.DoubleType)
    kind = "<f8" if wide else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b["vec"]
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0.0  # nulls are NaN; no negative zero
            ends = np.cumsum(size)
            raw = [x.astype(kind).tobytes() if _valid(x := flat[e - n : e]) else None for e, n in zip(ends.tolist(), size.tolist())]
            digest = [r and hashlib.sha256(r).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "vec"])

    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vec"))
    return rows.mapInArrow(run, "vec_id long, digest binary, vec binary")


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """The vectors (of one length) in double precision, scaled to length 1."""
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keys(unit: np.ndarray, number: int, off: Common | None = None) -> list[bytes]:
    """The key of each vector in this pass; off: what is taken off first."""
    directions = np.random.default_rng((number, unit.shape[1])).standard_normal((BITS, unit.shape[1]))
    if off is not None:
        unit, directions = unit - off.mean, directions - directions @ off.leading.T @ off.leading
    signs = np.packbits(unit @ directions.T >= 0, axis=1)
    return [s.tobytes() for s in signs]


def _keyed(nodes: DataFrame, numbers: list[int], kind: str, off: dict[int, Common]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b["vec"].to_pylist()
            size = np.array([len(r) for r in raw])
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                unit, take = units([raw[i] for i in at], kind), b.take(pa.array(at))
                for p in numbers:
                    cols = [pa.array(np.full(len(at), v)) for v in (p, n)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(keys(unit, p, off.get(n)), pa.binary()), take["node"], take["vec"]], ["pass", "dim", "key", "node", "vec"])

    return nodes.select("node", "vec").mapInArrow(run, "pass long, dim long, key binary, node long, vec binary")


class _Stars:
    """Pairs, thinned to those that join what this task hasn't joined yet."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        while (b := self.up.get(a, a)) != a:
            self.up[a] = a = self.up.get(b, b)
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _close(frame: pd.DataFrame, kind: str, cosine: float, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the sorted frame of pairs that are at most ``neighbours`` places apart and link."""
    group = frame["pass"].to_numpy() << 32 | frame["dim"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(frame)]
    first, second = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo < 2:
            continue
        x = units(frame["vec"].iloc[lo:hi].tolist(), kind)
        for d in range(1, min(neighbours, hi - lo - 1) + 1):
            ok = lo + np.flatnonzero(np.einsum("ij,ij->i", x[:-d], x[d:]) >= cosine)
            first.append(ok)
            second.append(ok + d)
    return np.concatenate(first), np.concatenate(second)


_FOUND = "part long, side long, at long, pass long, dim long, node long, other long, vec binary"


def _swept(keyed: DataFrame, parts: int, kind: str, cosine: float, neighbours: int) -> DataFrame:
    """Links (side 0: node, other) within each sorted partition, and its first (2) and last (1) rows, for what lies across."""
    order = ["pass", "dim", "key", "node"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, tail, head, stars = TaskContext.get().partitionId(), None, [], _Stars()
        for b in batches:
            if not len(b):
                continue
            if sum(map(len, head)) < neighbours:
                head.append(b.iloc[: neighbours - sum(map(len, head))])
            old = 0 if tail is None else len(tail)
            all_ = b if tail is None else pd.concat([tail, b], ignore_index=True)
            # what the last batch ended with has met its neighbours there: only pairs that end in this batch are new
            i, j = _close(all_, kind, cosine, neighbours)
            node = all_["node"].to_numpy()
            found = [(x, y) for x, y in zip(node[i[j >= old]].tolist(), node[j[j >= old]].tolist()) if stars.join(x, y)]
            if found:
                yield _rows(part, 0, pd.DataFrame(found, columns=["node", "other"]))
            if len(stars.up) > 1_000_000:
                stars = _Stars()
            tail = all_.iloc[-neighbours:]
        if tail is not None:
            for side, rows in ((1, tail), (2, pd.concat(head))):
                yield _rows(part, side, rows.assign(at=np.arange(len(rows))))

    return dealt.mapInPandas(run, _FOUND)


def _rows(part: int, side: int, rows: pd.DataFrame) -> pd.DataFrame:
    out = {c: rows[c].to_numpy() if c in rows else np.zeros(len(rows), dtype=np.int64) for c in ("at", "pass", "dim", "node", "other")}
    vec = rows["vec"].tolist() if "vec" in rows else [None] * len(rows)
    return pd.DataFrame({"part": part, "side": side, **out, "vec": vec})


def _across(found: DataFrame, kind: str, cosine: float, neighbours: int) -> DataFrame:
    """Links (node, other) between the last rows of a partition and the first of the next."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "at"]).reset_index(drop=True)
        last = (pdf["side"] == 1).to_numpy()
        i, j = _close(pdf, kind, cosine, neighbours)
        ok, node = last[i] & ~last[j], pdf["node"].to_numpy()
        return pd.DataFrame({"node": node[i[ok]], "other": node[j[ok]]})

    border = found.filter("side > 0").withColumn("border", F.when(F.col("side") == 1, F.col("part")).otherwise(F.col("part") - 1))
    return border.groupBy("border").applyInPandas(run, "node long, other long")


def _prefixes(nodes: DataFrame, numbers: list[int], bits: int, kind: str, off: dict[int, Common]) -> DataFrame:
    """(pass, dim, prefix, node): the first ``bits`` signs of each vector's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b["vec"].to_pylist()
            size = np.array([len(r) for r in raw])
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                unit, node = units([raw[i] for i in at], kind), b["node"].take(pa.array(at))
                for p in numbers:
                    cut = [(int.from_bytes(k, "big") >> BITS - bits).to_bytes(BITS // 8, "big") for k in keys(unit, p, off.get(n))]
                    cols = [pa.array(np.full(len(at), v)) for v in (p, n)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(cut, pa.binary()), node], ["pass", "dim", "prefix", "node"])

    return nodes.select("node", "vec").mapInArrow(run, "pass long, dim long, prefix binary, node long")


def _crowded(nodes: DataFrame, numbers: list[int], bits: int, kind: str, off: dict[int, Common], cosine: float, neighbours: int) -> DataFrame | None:
    """Links (node, other) of vectors that share a prefix with far more others than the window has places, thinned in each task.

    The vectors of a prefix are dealt out in blocks, and each two blocks meet in one task.
    """
    key = ["pass", "dim", "prefix"]
    placed = written(_prefixes(nodes, numbers, bits, kind, off), "prefixes")
    counts = placed.groupBy(*key).agg(F.count("*").alias("size")).filter(F.col("size") > CROWD * neighbours)
    counts = written(counts.withColumn("blocks", F.ceil(F.col("size") / CROWD_BLOCK).cast("int")).withColumn("crowd", F.monotonically_increasing_id()), "crowds")
    total, moved = counts.agg(F.sum("size"), F.sum(F.col("size") * F.col("blocks"))).first()
    if not total:
        return None
    most = max(CROWD * neighbours, total // len(numbers) // HOT_SHARE)
    hot, cold = counts.filter(F.col("size") > most), counts.filter(F.col("size") <= most)
    near = placed.join(F.broadcast(hot), key)
    far = placed.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key)
    dealt = near.unionByName(far).select("crowd", "blocks", "node").join(nodes.select("node", "vec"), "node")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "crowd"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")})
    tasks = max(64 * partitions(nodes.sparkSession), moved // (4 * CROWD_BLOCK))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stars, found = _Stars(), []
        for (_, lo, hi), g in pdf.groupby(["crowd", "lo", "hi"], sort=False):
            node, first = g["node"].to_numpy(), (g["block"] == lo).to_numpy()
            x = units(g["vec"].tolist(), kind)
            i, j = np.flatnonzero(first), np.flatnonzero(first if lo == hi else ~first)
            # the matrix product differs from the product by product in its last digits only
            a, b = np.nonzero(x[i] @ x[j].T >= cosine - 1e-9)
            a, b = i[a], j[b]
            for at in range(0, len(a), 1 << 16):
                p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                ok = (p != q) & (np.einsum("ij,ij->i", x[p], x[q]) >= cosine)
                found += [(s, t) for s, t in zip(node[p[ok]].tolist(), node[q[ok]].tolist()) if stars.join(s, t)]
        return pd.DataFrame(found, columns=["node", "other"], dtype="int64")

    deal = F.pmod(F.xxhash64("crowd", "lo", "hi"), F.lit(tasks))
    return dealt.select("crowd", "lo", "hi", "block", "node", "vec", deal.alias("deal")).groupBy("deal").applyInPandas(run, "node long, other long")


def _counted(members: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(node, links): rows linked to each node of a component (component, dim, node, n, vec), exactly, its own copies left out.

    A component's members are dealt out in blocks, and each two blocks meet in one task; only counts leave it.
    """
    size = members.groupBy("component").agg(F.count("*").alias("size"))
    dealt = members.join(size, "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    def count(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        node, n, block = g["node"].to_numpy(), g["n"].to_numpy(), g["block"].to_numpy()
        links = np.zeros(len(g), dtype=np.int64)
        size = np.array([len(v) for v in g["vec"]])
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            x = units(g["vec"].iloc[at].tolist(), kind)
            ok = np.zeros((len(at), len(at)), dtype=bool)
            for i in range(len(at)):  # product by product, as in the passes
                ok[i, i + 1 :] = np.einsum("ij,ij->i", np.broadcast_to(x[i], x[i + 1 :].shape), x[i + 1 :]) >= cosine
            ok |= ok.T
            if g["lo"].iat[0] != g["hi"].iat[0]:
                ok &= block[at][:, None] != block[at][None, :]
            links[at] += ok @ n[at]
        return node, links

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [count(g) for _, g in pdf.groupby(["component", "lo", "hi"], sort=False)]
        return pd.DataFrame({"node": np.concatenate([o[0] for o in out]), "links": np.concatenate([o[1] for o in out])})

    deal = F.pmod(F.xxhash64("component", "lo", "hi"), F.lit(64 * partitions(members.sparkSession)))
    cols = ["component", "lo", "hi", "block", "node", "n", "vec"]
    found = dealt.select(*cols, deal.alias("deal")).groupBy("deal").applyInPandas(run, "node long, links long")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``table``; other columns are not looked at.

    n_links: other rows whose vector has a cosine of at least ``cosine`` with this one, in double precision, within its
    component. component_id: the smallest vec_id that links reach. Equal vectors are one node, whatever their number.
    Vectors of different lengths never link. Null vectors, zero ones, and those that hold a null or a number that isn't
    finite link with nothing, and so does a row with a null id (component_id and kept null). Ids that repeat are rows of
    their own. An empty table gives no rows.
    """
    with Scratch(table.sparkSession) as scratch:
        return scratch.keep(_near(table, id_col, vector_col, cosine, neighbours), "near")


def _near(table: DataFrame, id_col: str, vector_col: str, cosine: float, neighbours: int) -> DataFrame:
    spark, kind = table.sparkSession, "<f8" if isinstance(table.schema[vector_col].dataType.elementType, T.DoubleType) else "<f4"
    rows = described(table, id_col, vector_col)
    distinct = rows.filter("digest IS NOT NULL AND vec_id IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    total, parts, links = nodes.count(), partitions(spark), None
    off = commons(nodes, kind)
    numbers = list(range(passes(total, min([cosine, *(x.cosine(cosine) for x in off.values())]), neighbours)))
    for i in range(0, len(numbers), AT_ONCE):
        found = written(_swept(_keyed(nodes, numbers[i : i + AT_ONCE], kind, off), parts, kind, cosine, neighbours), "pass")
        new = found.filter("side = 0").select("node", "other").union(_across(found, kind, cosine, neighbours))
        links = new if links is None else links.union(new)
    if (crowded := _crowded(nodes, numbers, prefix_bits(total, neighbours), kind, off, cosine, neighbours)) is not None:
        links = links.union(written(crowded, "crowded"))
    group = written(components(links.select(F.col("node").alias("a"), F.col("other").alias("b"))), "components")
    members = written(nodes.join(group, "node").select("component", "node", "rep", "n", "vec"), "members")
    least = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = members.select("component", "node").join(_counted(members, kind, cosine), "node").join(least, "component").select("node", "links", "component_id")
    each = nodes.select("digest", "node", "rep", "n").join(linked, "node", "left")
    each = each.select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component_id", "rep").alias("component_id"))
    key = (F.col("digest") == F.col("_digest")) & F.col("vec_id").isNotNull()
    out = rows.drop("vec").join(each.withColumnRenamed("digest", "_digest"), key, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def keep_one(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """The rows of ``table``, all columns, that stay: of each component, those with its smallest id; and rows without an id.

    Rows that link with nothing (null, zero or broken vectors) stay. Of rows that repeat the smallest id of a component all
    stay. An empty table gives no rows.
    """
    at = free(table, "gone")
    gone = near_vectors(table, id_col, vector_col, cosine).filter("NOT kept").select(F.col("vec_id").alias(at)).distinct()
    return table.join(gone, F.col(f"`{id_col}`") == F.col(at), "left_anti")

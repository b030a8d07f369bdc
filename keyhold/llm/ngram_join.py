"""N-gram Jaccard self-join by universe partition.

Two sets with Jaccard of at least 4/5 differ in at most (a + b) / 9 elements. The hash space is cut into segments so
many that, by the pigeonhole principle, two such sets agree on a segment: wholly, or up to one element where one-deletion
neighbourhoods are indexed too. Sizes are handled in bands, as the number of segments depends on the size. What agrees
becomes a candidate; candidates are verified on the whole sets, and links word by word.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from keyhold.llm.components import components
from keyhold.llm.shared import Scratch, free, hot_join, partitions, written
from keyhold.llm.shingles import WIDTH, U, link, lowered, mix, shingle_sets, words

NUM, DEN = 80, 100  # the similarity that links: 100 * intersection >= 80 * union
GROWTH = 1.25  # of a band's sizes: DEN / NUM, so partners are at most one band apart
FLUSH = 2_000_000  # signatures that a task holds before it sends them on
STEP = 250_000  # elements that are cut into segments at a time
BLOCK = 1_000  # members of a signature that are compared at a time
TOGETHER = 8_000  # members, over all signatures, that are compared in a task
PART = 2_000_000  # signatures that are grouped in a task


def limit(size: int) -> int:
    """Most elements in which a set of this size may differ from a larger one that it links with."""
    return (size + size * DEN // NUM) * (DEN - NUM) // (DEN + NUM)


@dataclass(frozen=True)
class Band:
    """How sets of low to high - 1 elements, and partners of up to 5/4 of that, are cut.

    units: parts of the hash space; the first 2 * wide of them pair up into ``wide`` segments that are indexed with
    their one-deletion neighbourhoods and count for two; the others count for one. skip: units that each set may leave
    out, its emptiest segments first. Any two sets keep units - 2 * skip > limit(high - 1) in common, so the pigeonhole
    argument holds whatever each of them skips.
    """

    low: int
    high: int
    units: int
    wide: int
    skip: int


def edges() -> list[int]:
    out = [4]  # below 4 elements, sets that link are equal
    while out[-1] < 1 << 34:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * GROWTH)))
    return out


EDGES = np.array(edges())


def allocate(low: int, high: int, sets: int) -> Band:
    """The cheapest cut for a band that holds so many sets: signatures written, against chance agreements to verify."""
    least, best = limit(high - 1) + 1, None
    for share in (0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 1):
        for spare in (0, 0.02, 0.04, 0.06, 0.08, 0.12, 0.16, 0.24, 0.32):
            skip = math.ceil(spare * least)
            units = least + 2 * skip
            wide = int(share * units / 2)
            fill = (low + high) / 2 / units  # mean elements of a unit
            bare = (units - 2 * wide) * math.exp(-fill) + wide * math.exp(-2 * fill) * (1 + 2 * fill)
            over = max(0.0, bare - skip) + 0.4 * math.sqrt(bare) * math.exp(-max(0.0, skip - bare) / math.sqrt(bare + 1e-9))
            chance = over * over / units  # that two unrelated sets agree somewhere
            cost = sets * (units - 2 * wide - skip + wide * (1 + 2 * fill)) + 4.0 * sets * sets / 2 * chance
            if best is None or cost < best[0]:
                best = cost, Band(low, high, units, wide, skip)
    return best[1]


def _segment_ids(unit: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Number of the segment of each unit; units 0 to 2 * wide - 1 pair up."""
    return np.where(unit < 2 * wide, unit >> 1, unit - wide)


def signatures(sets: list[np.ndarray], band_of: np.ndarray, plans: dict[int, Band]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of each indexed segment and deletion; sets of fewer than 4 elements have none.

    band_of: the band whose cut is used for each set, below 0: none.
    """
    use = [i for i, s in enumerate(sets) if band_of[i] >= 0 and len(s) >= 4]
    if not use:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    cut = [plans[int(band_of[i])] for i in use]
    size = np.array([len(sets[i]) for i in use])
    units, wide, skip = (np.array([getattr(c, k) for c in cut]) for k in ("units", "wide", "skip"))
    salt = mix(np.array([c.low for c in cut], dtype=U) + U(77))
    x = np.concatenate([sets[i] for i in use])
    doc = np.repeat(np.arange(len(use)), size)
    unit = ((x >> U(32)) * units.astype(U)[doc] >> U(32)).astype(np.int64)
    seg = _segment_ids(unit, wide[doc])
    x = mix(x + U(0x51ED))
    first = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.append(first, len(x)))
    total = np.add.reduceat(x, first)
    sdoc, sseg = doc[first], seg[first]
    weight = np.where(sseg < wide[sdoc], 2, 1)
    # what each set leaves out: empty segments first, then those with the fewest elements
    present = np.bincount(sdoc, weights=weight, minlength=len(use)).astype(np.int64)
    left = skip - (units - present)
    order = np.lexsort((total, count, sdoc))
    paid = np.cumsum(weight[order])
    start = np.searchsorted(sdoc[order], np.arange(len(use)))
    paid -= (paid[start] - weight[order][start])[sdoc[order]]
    keep = np.zeros(len(first), dtype=bool)
    keep[order] = paid > np.maximum(left, 0)[sdoc[order]]
    base = mix(salt[sdoc] + sseg.astype(U))
    out_doc, out_sig = [sdoc[keep]], [mix(total[keep] + base[keep])]
    wide_seg = keep & (sseg < wide[sdoc])
    if wide_seg.any():
        el = np.repeat(wide_seg, count)
        of = np.repeat(np.arange(len(first)), count)[el]
        out_doc.append(sdoc[of])
        out_sig.append(mix(total[of] - x[el] + base[of]))
    for d in np.flatnonzero(left < 0):  # more empty segments than may be left out: index the rest as they are
        c = cut[d]
        have = set(sseg[sdoc == d].tolist())
        need = -left[d]
        for s in range(c.units - c.wide - 1, -1, -1):
            if need <= 0:
                break
            if s not in have:
                need -= 2 if s < c.wide else 1
                out_doc.append(np.array([d]))
                out_sig.append(mix(mix(salt[d : d + 1] + U(s))))
    return np.array(use)[np.concatenate(out_doc)], np.concatenate(out_sig)


def set_key(s: np.ndarray, text: str | None) -> tuple[int, int]:
    """48 bits that signatures carry, and 64 more, that name a set; of a single shingle, the latter come from its words."""
    two = np.concatenate((mix(s + U(1)).sum(dtype=U, keepdims=True), mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U, keepdims=True))) + U(len(s))
    k0, k1 = mix(two).view(np.int64).tolist()
    k0 &= (1 << 48) - 1
    if len(s) == 1:
        k1 = int.from_bytes(hashlib.blake2b(b" ".join(words(text)[:WIDTH]), digest_size=8).digest(), "little", signed=True)
    return k0, k1


def width(n: int) -> int:
    """Bits of the bitmap of a set of n elements: a power of two, and enough that few elements share a bit."""
    return max(512, 1 << (4 * n - 1).bit_length())


def bitmap(s: np.ndarray) -> bytes:
    """Parity bits of a set: two sets differ in at least as many elements as their bitmaps do in bits."""
    m = width(len(s))
    odd = np.bincount((s & U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Bitmaps:
    """Bitmaps by position; one of twice the width is folded, half onto half, to compare it with a smaller one."""

    def __init__(self, raw: list[bytes]) -> None:
        self.width = np.array([8 * len(r) for r in raw], dtype=np.int64)
        self.rows, self.at = {}, {}
        for w in np.unique(self.width).tolist():
            own, twice = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            rows = np.frombuffer(b"".join(raw[i] for i in own), dtype=U).reshape(len(own), -1)
            if len(twice):
                wide = np.frombuffer(b"".join(raw[i] for i in twice), dtype=U).reshape(len(twice), 2, -1)
                rows = np.concatenate((rows, wide[:, 0] ^ wide[:, 1]))
            self.rows[w], self.at[w] = rows, np.zeros(len(raw), dtype=np.int64)
            self.at[w][np.concatenate((own, twice))] = np.arange(len(rows))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many bits those at x and y differ; widths differ by a factor of two at most."""
        out, less = np.zeros(len(x), dtype=np.int64), np.minimum(self.width[x], self.width[y])
        for w in np.unique(less).tolist():
            at, rows, k = self.at[w], self.rows[w], np.flatnonzero(less == w)
            for i in range(0, len(k), step := max(1, 1 << 27 - w.bit_length())):
                j = k[i : i + step]
                out[j] = np.bitwise_count(rows[at[x[j]]] ^ rows[at[y[j]]]).sum(axis=1, dtype=np.int64)
        return out


def may_link(n: np.ndarray, bits: Bitmaps, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs at x and y sizes and bitmaps don't rule out, and how far apart these are at least, as a share of
    their sizes; exact, as neither ever rules out a pair that links."""
    ok = np.flatnonzero(np.minimum(n[x], n[y]) * DEN >= np.maximum(n[x], n[y]) * NUM)
    apart, both = bits.apart(x[ok], y[ok]), n[x[ok]] + n[y[ok]]
    keep = apart * (DEN + NUM) <= both * (DEN - NUM)
    return ok[keep], apart[keep] / both[keep]


def _named_sets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, tuple[int, int]]]:
    """The shingle set of each text, and its name; (0, 0) for an empty one."""
    for text, s in zip(texts, shingle_sets(texts)):
        yield s, set_key(s, text) if len(s) else (0, 0)


def exact_name(text: str | None) -> bytes:
    """A digest of the words of a text's shingle set, so equal for equal sets only."""
    w = words(text)
    some = sorted({b" ".join(w[i : i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))})
    return hashlib.blake2b(b"\n".join(some), digest_size=16).digest()


def raw_name(text: str | None) -> bytes:
    """A digest of a text but for upper case; equal texts have equal sets."""
    return hashlib.blake2b(lowered(text), digest_size=16).digest()


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k0, k1, bits, raw) of each row: size, name and bitmap of its shingle set, and the name of its text."""
    names = ["doc_id", "n", "k0", "k1", "bits", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            rows = [(len(s), *key, bitmap(s), raw_name(x)) for x, (s, key) in zip(texts, _named_sets(texts))]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *cols], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, k0 long, k1 long, bits binary, raw binary")


def _told_apart(docs: DataFrame) -> DataFrame:
    """What ``described`` gives, with ``exact``, which tells sets of one hashed name apart.

    It is empty where all texts of the name are equal but for upper case, and else a digest of the set's words; only the
    texts of such names are read again.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = written(described(docs), "hashed")
        name = ["n", "k0", "k1"]
        named = found.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*name).agg(F.min("raw").alias("r0"), F.max("raw").alias("r1"), F.count("*").alias("rows"))
        several = written(named.filter("r0 <> r1").select(*name, "rows", F.lit(True).alias("several")), "several")
        total = found.count()
        if several.isEmpty():
            return scratch.keep(found.select("doc_id", *name, "bits", F.lit(b"").alias("exact")), "sets")
        marked = written(hot_join(found, several, name, "rows", ["several"], total), "marked")
        # a text of each different name will do
        ask = marked.filter("several AND doc_id IS NOT NULL").groupBy("raw").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"))
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ask.select("id").distinct(), "id", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b["text"].to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(map(f, texts), pa.binary()) for f in (raw_name, exact_name)], ["raw", "exact"])

        exact = texts.select("text").mapInArrow(run, "raw binary, exact binary").groupBy("raw").agg(F.min("exact").alias("exact"))
        exact = written(exact.join(ask.select("raw", "rows"), "raw"), "exact")
        out = hot_join(marked.filter("several"), exact, ["raw"], "rows", ["exact"], total).unionByName(marked.filter("several IS NULL").withColumn("exact", F.lit(b"")))
        return scratch.keep(out.select("doc_id", *name, "bits", F.coalesce("exact", F.lit(b"")).alias("exact")), "sets")


def _indexed(docs: DataFrame, plans: dict[int, Band], parts: int) -> DataFrame:
    """(p, entries, stars): signatures, packed by the partition they are dealt to, in 48 bits each: most of what the join
    shuffles at once. Where two agree by chance, their sets become a candidate that verification rules out.

    A task combines what it holds first: a signature that several of its sets share goes on once, for the smallest key,
    and the others are told of by stars (signature, smallest key, key), dealt out by their own key.
    """
    def send(sigs: list[np.ndarray], keys: list[np.ndarray]) -> pd.DataFrame:
        sig, key = np.concatenate(sigs) >> U(16), np.concatenate(keys)
        sig, low, star = combine(sig, key)
        entries = _packed(((sig >> U(16)) * U(parts) >> U(32)).astype(np.int64), sig, low)
        stars = _packed((mix(star[2].view(U)) % U(parts)).astype(np.int64), *star)
        at = sorted(entries.keys() | stars.keys())
        return pd.DataFrame({"p": at, "entries": [entries.get(x, b"") for x in at], "stars": [stars.get(x, b"") for x in at]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sigs, keys, held, seen = [], [], 0, set()

        def index(sets: list[np.ndarray], names: list[int]) -> int:
            band, new = np.searchsorted(EDGES, [len(s) for s in sets], side="right") - 1, 0
            for shift in (0, 1):
                at, sig = signatures(sets, np.where([k - shift in plans for k in band.tolist()], band - shift, -1), plans)
                sigs.append(sig)
                keys.append(np.array(names, dtype=np.int64)[at])
                new += len(sig)
            return new

        for b in batches:
            sets, names, size = [], [], 0
            for s, name in _named_sets(b["text"].tolist()):
                if len(s) < 4 or name in seen:  # copies within a task are indexed once
                    continue
                seen.add(name)
                sets.append(s)
                names.append(name[0])
                size += len(s)
                if size > STEP:
                    held += index(sets, names)
                    sets, names, size = [], [], 0
                if held > FLUSH:
                    yield send(sigs, keys)
                    sigs, keys, held = [], [], 0
            if sets:
                held += index(sets, names)
            if len(seen) > FLUSH:
                seen.clear()
        if held:
            yield send(sigs, keys)

    return docs.filter("doc_id IS NOT NULL").select("text").mapInPandas(run, "p long, entries binary, stars binary")


def _packed(p: np.ndarray, *cols: np.ndarray) -> dict[int, bytes]:
    """By p, the low 48 bits of each column's values, one column after the other."""
    if not len(p):
        return {}
    order = np.argsort(p, kind="stable")
    p, cols = p[order], [c[order] for c in cols]
    cuts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))).tolist()
    return {int(p[a]): b"".join(c[a:b].view(np.uint16).reshape(-1, 4)[:, :3].tobytes() for c in cols) for a, b in zip(cuts, [*cuts[1:], len(p)])}


def _unpacked(raw: bytes, cols: int) -> list[np.ndarray]:
    """The columns that ``_packed`` put there."""
    some = np.frombuffer(raw, np.uint16).reshape(cols, -1, 3)
    out = np.zeros((*some.shape[:2], 4), dtype=np.uint16)
    out[:, :, :3] = some
    return list(out.view(np.int64)[:, :, 0])


def _heads(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (signature, key), which of them open a signature, and each one's smallest key."""
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    first = np.ones(len(sig), dtype=bool)
    first[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[first], key[first]
    head = np.ones(len(sig), dtype=bool)
    head[1:] = sig[1:] != sig[:-1]
    return sig, key, head, key[np.maximum.accumulate(np.where(head, np.arange(len(sig)), 0))]


def combine(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each signature once with its smallest key, and stars (signature, smallest key, other key)."""
    sig, key, head, low = _heads(sig, key)
    return sig[head], key[head], (sig[~head].view(np.int64), low[~head], key[~head])


def _stars(index: DataFrame) -> DataFrame:
    """(sig, a, b): every signature's keys but the smallest, with the smallest of their task or of all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        raw = [_unpacked(x, 2) for x in pdf["entries"] if x]
        if raw:
            sig, key = (np.concatenate(c) for c in zip(*raw))
            out.append(combine(sig, key)[2])
        out += [tuple(_unpacked(x, 3)) for x in pdf["stars"] if x]
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 3
        return pd.DataFrame(dict(zip(("sig", "a", "b"), cols)))

    return index.groupBy("p").applyInPandas(run, "sig long, a long, b long")


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b) of nodes that sizes and bitmaps don't rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, bits, k = np.concatenate((b["na"], b["nb"])), Bitmaps([*b["xa"], *b["xb"]]), np.arange(len(b))
            yield b[["a", "b"]].iloc[may_link(n, bits, k, k + len(b))[0]]

    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"x{side}")), side)
    return pairs.select("a", "b", "na", "nb", "xa", "xb").mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link: hashed sets sort out those that don't, and words decide the others."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ask = nodes.join(wanted, "node", "left_semi").select("node", F.col("rep").alias("id"), "n", "k0", "k1", "exact")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ask, "id")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # where an id repeats, several rows come for a node
            keys, texts, exact = zip(b["n"].to_pylist(), b["k0"].to_pylist(), b["k1"].to_pylist()), b["text"].to_pylist(), b["exact"].to_pylist()
            ok = pa.array([(len(s), *name) == key and (not e or exact_name(x) == e) for x, e, (s, name), key in zip(texts, exact, _named_sets(texts), keys)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["node"], b["text"]], ["node", "text"]).filter(ok)

    known = written(texts.mapInArrow(own, "node long, text string").dropDuplicates(["node"]), "texts")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for lo in range(0, len(b), 500):
                some = b.iloc[lo : lo + 500]
                text = dict(zip(some["a"], some["x"])) | dict(zip(some["b"], some["y"]))
                sets = dict(zip(text, shingle_sets(list(text.values()))))
                word: dict[int, list[bytes]] = {}
                for x, y in zip(some["a"].tolist(), some["b"].tolist()):
                    z = np.sort(np.concatenate((sets[x], sets[y])), kind="stable")
                    both = int((z[1:] == z[:-1]).sum())
                    good = DEN * both >= NUM * (len(z) - both)
                    if good:
                        for k in (x, y):
                            if k not in word:
                                word[k] = words(text[k])
                        good = link(word[x], word[y], NUM, DEN)
                    ok.append(good)
            yield b.loc[ok, ["a", "b"]]

    one = pairs.join(known.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    two = one.join(known.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInPandas(test, "a long, b long")


def spanning(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Positions of edges (a, b) of a spanning forest of least cost: each part takes its cheapest edge, until none is left."""
    both, label = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, edge, out = label[: len(a)], label[len(a) :], np.argsort(cost, kind="stable"), [np.zeros(0, dtype=np.int64)]
    part = np.arange(len(both))
    while len(edge := edge[part[a[edge]] != part[b[edge]]]):
        end = np.stack((part[a[edge]], part[b[edge]]), axis=1).ravel()
        took = np.unique(edge[np.unique(end, return_index=True)[1] // 2])
        for i, j in zip(a[took].tolist(), b[took].tolist()):
            x, y = part[i], part[j]
            if x != y:
                part[part == max(x, y)] = min(x, y)
        out.append(took)
    return np.concatenate(out)


def _rest(stars: DataFrame, nodes: DataFrame, where: DataFrame, forest: bool) -> DataFrame:
    """(a, b) of pairs of nodes that share a signature with further members, may link, and whose components differ.

    forest: of the pairs that meet in a task, only so many that they would join all its components, the closest ones.
    where: (k0, node, component). Signatures whose members are all joined are dropped first. Members of the others are
    dealt out in blocks, and each two blocks meet in one task. Signatures of one neighbourhood mostly hold the same
    members, so several of them share a task, as many as hold TOGETHER members; the bitmaps come to it once.
    """
    several = stars.groupBy("sig").count().filter("count > 1").select("sig")
    kept = stars.join(several, "sig", "left_semi")
    members = written(kept.select("sig", F.col("a").alias("k0")).union(kept.select("sig", F.col("b").alias("k0"))).distinct().join(where, "k0").select("sig", "node", "component"), "members")
    size = members.groupBy("sig").agg(F.count("*").alias("members"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1")
    size = written(size.select("sig", "c0", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), "members"), "open")
    salts = size.groupBy("c0").agg(F.ceil(F.sum(F.col("members") * F.col("blocks")) / F.sum("blocks") * F.count("*") / TOGETHER).alias("salts"))
    dealt = members.join(size.join(salts, "c0"), "sig")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    dealt = dealt.withColumn("deal", F.xxhash64("c0", F.pmod(F.xxhash64("sig"), F.col("salts")), "lo", "hi"))
    dealt = written(dealt.select("deal", "sig", "lo", "hi", "block", "node", "component"), "dealt")
    known = dealt.select(F.col("deal").alias("at"), "node").distinct().join(nodes.select("node", "n", "bits"), "node")
    known = known.select("at", F.col("node").alias("member"), F.col("n").alias("size"), F.col("bits").alias("map"))

    def pairs(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        known = known.sort_values("member")
        node, n, bits = known["member"].to_numpy(), known["size"].to_numpy(), Bitmaps(known["map"].tolist())
        place = np.searchsorted(node, pdf["node"].to_numpy())
        component = np.zeros(len(node), dtype=np.int64)
        component[place] = pdf["component"].to_numpy()
        rows = np.stack([*(pdf[c].to_numpy() for c in ("sig", "lo", "hi", "component", "block")), place])
        rows = rows[:, np.lexsort((rows[5], rows[2], rows[1], rows[0]))]
        cuts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        met, held, seen = [], 0, set()
        for g in np.split(rows, cuts, axis=1):
            if (name := g[1:].tobytes()) in seen:  # the same members as under another signature
                continue
            seen.add(name)
            i, j = np.triu_indices(g.shape[1], 1)
            ok = g[3, i] != g[3, j]
            if g[1, 0] != g[2, 0]:
                ok &= g[4, i] != g[4, j]
            met.append(g[5, i[ok]] * len(node) + g[5, j[ok]])
            held += len(met[-1])
            if held > 4_000_000:
                met = [np.unique(np.concatenate(met))]
                held = len(met[0]) // 2
        x, y = np.divmod(np.unique(np.concatenate(met)), len(node))
        at, apart = may_link(n, bits, x, y)
        if forest:
            at = at[spanning(component[x[at]], component[y[at]], apart)]
        return pd.DataFrame({"a": node[x[at]], "b": node[y[at]]})

    return dealt.groupBy("deal").cogroup(known.groupBy("at")).applyInPandas(pairs, "a long, b long")


def _components(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, k0, k1, exact) of each row, and (n, k0, k1, exact, cluster, component_id) of each set; cluster: a component's own number."""
    spark = docs.sparkSession
    found = _told_apart(docs)
    nodes = found.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "k0", "k1", "exact").agg(F.min("doc_id").alias("rep"), F.min("bits").alias("bits"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    wide, found = found, written(found.drop("bits"), "sets")
    scratch.drop(wide)  # bitmaps are a node's from now on
    edge = F.array([F.lit(int(e)) for e in EDGES])
    bands = nodes.filter("n >= 4").groupBy((F.array_size(F.filter(edge, lambda e: e <= F.col("n"))) - 1).alias("band")).count().collect()  # a row a band
    plans = {r.band: allocate(int(EDGES[r.band]), int(EDGES[r.band + 1]), r["count"]) for r in bands}
    # about as many signatures as sets have, under their own band's cut and the next lower one's
    total = sum(2 * r["count"] * (plans[r.band].units + plans[r.band].wide * (r.band and (plans[r.band].low + plans[r.band].high) / plans[r.band].units)) for r in bands)
    parts = max(4 * partitions(spark), int(total / PART))
    stars = written(_stars(_indexed(docs, plans, parts)), "stars")
    shared = written(_named(stars.groupBy("a", "b").count(), nodes).groupBy("a", "b").agg(F.sum("count").alias("count")), "shared")
    best = shared.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    tested = written(plausible(best.union(_clashes(nodes)).distinct(), nodes), "pairs")
    links = _confirmed(tested, nodes, docs)
    where = _where(nodes, links)
    for forest in (True, False):
        with Scratch(spark) as inner:
            open_ = _apart(shared.select("a", "b").join(tested, ["a", "b"], "left_anti"), where).select("a", "b")
            some = plausible(open_, nodes).union(_rest(stars, nodes, where, forest)).distinct()
            some = inner.keep(some.join(tested, ["a", "b"], "left_anti"), "pairs")
        if some.isEmpty():
            continue
        again = _confirmed(some, nodes, docs)
        tested = tested.union(some)
        if not again.isEmpty():
            links = links.union(again)
            scratch.drop(where)
            where = _where(nodes, links)
    least = where.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    member = nodes.select("n", "k0", "k1", "exact", "node").join(where.select("node", F.col("component")), "node").join(least, "component")
    return found, member.select("n", "k0", "k1", "exact", F.col("component").alias("cluster"), "component_id")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(verified(pairs, nodes, docs), "links")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs`` (doc_id, text; other columns are not looked at).

    Two documents link when 100 * intersection >= 80 * union of their sets of distinct five-word shingles; component_id
    is the smallest doc_id that links reach. Documents with equal sets are one node, and count as linked. Null or empty
    texts, or texts without words, have no shingles and link with nothing. A null doc_id links with nothing either
    (component_id null). Rows whose ids repeat are documents of their own. An empty table gives no rows.

    Candidates are sought by 64-bit hashes of words; a link is taken after its words have been compared, and sets of one
    hashed name but different texts are told apart by a digest of their words.
    Links are verified in three rounds. In the first, each set meets the one set with which it shares most signatures; in
    the second, the closest pairs that would join the components whose sets share signatures; in the third, all other
    pairs that share one and aren't joined yet. Nothing is lost by skipping joined pairs, as only the components are asked for.
    """
    with Scratch(docs.sparkSession) as scratch:
        found, member = _components(docs, scratch)
        return scratch.keep(_members(found, member), "near")


def _where(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(k0, node, component) of each node."""
    with Scratch(nodes.sparkSession) as scratch:
        found = nodes.select("k0", "node").join(components(links), "node", "left")
        return scratch.keep(found.select("k0", "node", F.coalesce("component", "node").alias("component")), "components")


def _apart(pairs: DataFrame, where: DataFrame) -> DataFrame:
    """The pairs (a, b) whose components (ca, cb) differ."""
    for side in "ab":
        pairs = pairs.join(where.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side)
    return pairs.filter("ca <> cb")


def _named(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, count) of keys as pairs of nodes, the smaller first."""
    for side in "ab":
        pairs = pairs.withColumnRenamed(side, "k0").join(nodes.select("k0", F.col("node").alias(side)), "k0").drop("k0")
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "count")


def _clashes(nodes: DataFrame) -> DataFrame:
    """Pairs of different sets whose short keys are equal, which signatures can't tell apart."""
    same = nodes.groupBy("k0").agg(F.count("*").alias("c")).filter("c > 1").select("k0")
    clash = nodes.join(same, "k0", "left_semi").select("k0", "node")
    return clash.join(clash.withColumnRenamed("node", "other"), "k0").filter("node < other").select(F.col("node").alias("a"), F.col("other").alias("b"))


def _members(found: DataFrame, member: DataFrame) -> DataFrame:
    own = found.select("doc_id", F.col("n").alias("n_shingles"), "k0", "k1", "exact")
    key = [own[k] == member[k] for k in ("k0", "k1", "exact")] + [own["n_shingles"] == member["n"], own["n_shingles"] > 0, own["doc_id"].isNotNull()]
    out = own.join(member, key, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each component exactly one, the row with its smallest doc_id.

    Rows without words, and those with a null doc_id, link with nothing and stay. Where ids repeat, rows are told apart by
    their texts, so that each goes with its own component only; of rows that repeat the smallest id of a component, one
    stays. An empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        found, member = _components(docs, scratch)
        member = scratch.keep(member, "member")
        near = scratch.keep(_members(found, member), "near")
        twice = scratch.keep(near.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
        repeats = not twice.isEmpty()
    at = free(docs, "gone")
    gone = near.filter("component_id < doc_id").select(F.col("doc_id").alias(at))
    if not repeats:
        return docs.join(gone, F.col("doc_id") == F.col(at), "left_anti")
    again = twice.select(F.col("doc_id").alias(at))
    single = docs.join(gone.union(again).distinct(), F.col("doc_id") == F.col(at), "left_anti")
    return single.unionByName(_keep_repeated(docs.join(again, F.col("doc_id") == F.col(at), "left_semi"), member))


def _keep_repeated(docs: DataFrame, member: DataFrame) -> DataFrame:
    """Of rows whose ids repeat, those that stay."""
    n, k0, k1, exact, cluster, least, rank = (free(docs, c) for c in ("n", "k0", "k1", "exact", "cluster", "least", "rank"))
    extra = [*(T.StructField(c, T.LongType()) for c in (n, k0, k1)), T.StructField(exact, T.BinaryType())]
    schema = T.StructType([*docs.schema.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            keys = [(len(s), *key) for s, key in _named_sets(texts)]
            cols = [*(pa.array([k[i] for k in keys], pa.int64()) for i in range(3)), pa.array(map(exact_name, texts), pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], schema.names)

    rows = docs.mapInArrow(run, schema)
    of = member.select(F.col("n").alias("m"), F.col("k0").alias("m0"), F.col("k1").alias("m1"), F.col("exact").alias("e"), F.struct("cluster", "component_id").alias("of"))
    same = [rows[n] == of["m"], rows[k0] == of["m0"], rows[k1] == of["m1"], (of["e"] == F.lit(b"")) | (of["e"] == rows[exact])]
    rows = rows.join(of, same, "left").select(*(rows[c] for c in rows.columns), of["of.cluster"].alias(cluster), of["of.component_id"].alias(least))
    empty, full = rows.filter(F.col(n) == 0), rows.filter((F.col(n) > 0) & (F.col("doc_id") == F.col(least)))
    first = full.withColumn(rank, F.row_number().over(Window.partitionBy(cluster).orderBy(n, k0, k1, exact))).filter(F.col(rank) <= 1)
    return empty.select(docs.columns).unionByName(first.select(docs.columns))

"""A trie of conversations by their prefixes.

Each prefix of a conversation has a digest, and of the conversations that share it the smallest id owns it. Once a
conversation owns a prefix it owns all longer ones, so its first owned depth is found by binary search: in each round,
all conversations look up the digest in the middle of what is left, in one join against the least id of each shared
digest. What a conversation owns is a chain of nodes; chains hang on nodes of other chains. Totals go from chains to the
chains above them in doubling steps, and then along each chain.

A prefix's digest is the sum of keyed digests of (depth, turn), in four lanes of 32 bits; the key is drawn anew at each
call, so texts can't be made to meet. Sums along a conversation come from ``scan``, which splits a long one over tasks.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyhold.llm.shared import Scratch, hot_join, partitions, written
from keyhold.operators.scan import scan

BLOCK = 64  # depths of a conversation that are searched together
LANES = [f"d{i}" for i in range(4)]
DIGEST = [f"run_{c}" for c in LANES]


def ranked(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, sha, n_chars): each turn's place in its conversation, from 0, a digest of role and text, and its length.

    Turns are in order of turn (null first), role, and the text's SHA-256; equal turns all count. A null role or text
    counts as empty; rows without an id are left out. The id becomes a long.
    """
    col = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    turns = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), col(role_col).alias("role"), col(text_col).alias("text")).filter("conv IS NOT NULL")
    hashed = turns.select("conv", "turn", "role", F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha"), F.char_length("text").cast("long").alias("n_chars"))
    out = scan(hashed, "conv", [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text_sha")], [], lambda d: written(d, "turns"), partitions(conversations.sparkSession))
    return out.select("conv", "pos", F.sha2(F.concat(F.unhex(F.sha2(F.encode("role", "utf-8"), 256)), F.unhex("text_sha")), 256).alias("sha"), "n_chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with shared beginnings, for the report, from ``ranked`` turns: (conv, depth, sha, n_chars), (conv, length).

    Conversation c begins with the first h turns of conversation c - c % 100 (none, if there isn't such a one) and goes
    on with its own turns after its first h; h is the CRC-32 of its decimal id modulo 6. Depths start at 1.
    """
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    heads = turns.filter((F.col("conv") % 100 == 0) & (F.col("pos") < 5)).groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "sha", "n_chars"))).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    convs = own.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % 100}).join(heads, "base", "left")
    convs = convs.withColumn("head", F.when(F.col("head").isNull(), F.slice(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("sha"), F.lit(0).cast("long").alias("n_chars"))), 1, 0)).otherwise(F.slice("head", 1, F.col("h"))))
    convs = convs.withColumn("k", F.size("head").cast("long")).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv", "n", "h", "k", "head", "length"), "convs")
    begun = convs.select("conv", F.posexplode("head").alias("at", "turn")).select("conv", (F.col("at") + 1).cast("long").alias("depth"), "turn.sha", "turn.n_chars")
    total = convs.agg(F.sum("n")).first()[0] or 0
    rest = hot_join(turns, convs, ["conv"], "n", ["h", "k"], total).filter("pos >= h")
    return begun.unionByName(rest.select("conv", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "sha", "n_chars")), convs.select("conv", "length")


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the trie of whole conversations; columns as in ``trie``, odd rows as in ``ranked``."""
    with Scratch(conversations.sparkSession) as scratch:
        turns = ranked(conversations, id_col, turn_col, role_col, text_col)
        convs = turns.groupBy("conv").agg(F.count("*").alias("length"))
        return scratch.keep(trie(turns.select("conv", (F.col("pos") + 1).alias("depth"), "sha", "n_chars"), convs), "nodes")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rebuilt`` conversations."""
    with Scratch(conversations.sparkSession) as scratch:
        return scratch.keep(trie(*rebuilt(ranked(conversations))), "nodes")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included: conv_id (smallest member), depth,
    parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes at or below it), saved_tokens (at or below it:
    members but one, times the code points of the last text), ends_sha256 (SHA-256 of the ids that end at it, ascending, with
    commas between).

    turns: (conv, depth from 1 without gaps, sha, n_chars); convs: (conv, length), every conversation once, those without
    turns too. No conversations: no rows.
    """
    spark = turns.sparkSession
    with Scratch(spark) as scratch:
        convs = written(convs, "lengths")
        first, most, total = convs.agg(F.min("conv"), F.max("length"), F.sum("length")).first()
        prefixes = _prefixes(turns)
        searched = _first_owned(prefixes, min(BLOCK, most or 0), total or 0)
        chars = prefixes.groupBy("conv").agg(F.sum("n_chars").alias("chars"))
        root = F.col("conv") == F.lit(first)
        chains = convs.join(searched, "conv", "left").join(chars, "conv", "left").select(
            "conv", "length", F.coalesce("chars", F.lit(0)).alias("chars"),
            F.when(root, 0).otherwise(F.coalesce("first", F.col("length") + 1)).cast("long").alias("top"),
            F.when(~root, F.coalesce("owner", F.lit(first))).cast("long").alias("above"),
        )
        chains = written(chains, "chains")
        own = hot_join(prefixes.select("conv", "depth", "n_chars", F.col("run_n_chars").alias("upto")), chains, ["conv"], "length", ["top", "above", "length"], total or 0).filter("depth >= top")
        zero = F.lit(0).cast("long")
        own = own.unionByName(chains.filter("top = 0").select("conv", zero.alias("depth"), zero.alias("n_chars"), zero.alias("upto"), "top", "above", "length"))
        own = written(own, "nodes")
        # a conversation without a chain ends at the node that its whole text led to
        ended = chains.select(F.when(F.col("top") <= F.col("length"), F.col("conv")).otherwise(F.col("above")).alias("owner"), F.col("length").alias("at"), "conv", "chars")
        at_node = ended.groupBy("owner", "at").agg(F.count("*").alias("n"), F.sum("chars").alias("g"))
        hung = _totals(chains, own, at_node)
        return scratch.keep(_nodes(own, at_node, hung, _ends(ended)), "trie")


def _prefixes(turns: DataFrame) -> DataFrame:
    """The turns with ``DIGEST`` of the prefix that each ends, and run_n_chars, its code points."""
    key = F.unhex(F.lit(secrets.token_hex(32)))
    keyed = F.sha2(F.concat(key, F.unhex("sha"), F.col("depth").cast("string").cast("binary")), 256)
    rows = turns.withColumn("sha", keyed)
    rows = rows.select("conv", "depth", "n_chars", *(F.conv(F.substring("sha", 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(LANES)))
    return scan(rows, "conv", [F.asc("depth")], [*LANES, "n_chars"], lambda d: written(d, "prefixes"), partitions(turns.sparkSession)).drop("pos", *LANES)


def _first_owned(prefixes: DataFrame, most: int, total: int) -> DataFrame:
    """(conv, first, owner): the first depth that a conversation owns (null: none), and who owns the prefix before it
    (null: that is the empty one). A long conversation's blocks of depths are searched side by side."""
    least = prefixes.groupBy("depth", *DIGEST).agg(F.min("conv").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    least = written(least, "minima")  # prefixes of one conversation alone are its own
    entry = F.struct("depth", *DIGEST)
    state = prefixes.groupBy("conv", F.floor((F.col("depth") - 1) / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("left"))
    none = F.lit(None).cast("long")
    state, found = state.select("conv", "block", "left", none.alias("first"), none.alias("below"), none.alias("owner")), []
    for _ in range(most.bit_length()):
        middle = F.floor(F.size("left") / 2).cast("int")
        probe = state.withColumn("middle", middle).withColumn("probe", F.element_at("left", F.col("middle") + 1))
        probe = probe.select("conv", "block", "left", "middle", "first", "below", F.col("owner").alias("was"), "probe.*")
        told = hot_join(probe, least, ["depth", *DIGEST], "n", ["owner"], total)
        mine = F.coalesce(F.col("owner") == F.col("conv"), F.lit(True))
        state = written(told.select(
            "conv", "block",
            F.when(mine, F.slice("left", 1, F.col("middle"))).otherwise(F.slice("left", F.col("middle") + 2, F.size("left"))).alias("left"),
            F.when(mine, F.col("depth")).otherwise(F.col("first")).alias("first"),
            F.when(mine, F.col("below")).otherwise(F.col("depth")).alias("below"),
            F.when(mine, F.col("was")).otherwise(F.col("owner")).alias("owner"),
        ), "search")
        found.append(state.filter("size(left) = 0").select("conv", "first", "below", "owner"))
        state = state.filter("size(left) > 0")
    if not found:
        return state.select("conv", "first", "owner").limit(0)
    done = found[0]
    for f in found[1:]:
        done = done.union(f)
    return done.groupBy("conv").agg(F.min("first").alias("first"), F.max_by("owner", "below").alias("owner"))


def _totals(chains: DataFrame, own: DataFrame, at_node: DataFrame) -> DataFrame:
    """(owner, at, children, n, leaves, g): what the chains that hang on a node sum up to.

    n: conversations; leaves: childless nodes; g: the code points of these conversations less those of the chains' nodes.
    A chain hands its sums to the chain above it, and in each round looks twice as far up.
    """
    with Scratch(chains.sparkSession) as scratch:
        held = chains.filter("top <= length").select("conv", "length", "top", "above")
        used = held.filter("above IS NOT NULL").select(F.col("above").alias("conv"), (F.col("top") - 1).alias("length")).distinct().withColumn("inner", F.lit(True))
        ends = at_node.groupBy(F.col("owner").alias("conv")).agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
        texts = own.groupBy("conv").agg(F.sum("n_chars").alias("texts"))
        state = held.join(used, ["conv", "length"], "left").join(ends, "conv", "left").join(texts, "conv", "left")
        zero = F.lit(0).cast("long")
        state = written(state.select(
            "conv", "above", "top", F.col("above").alias("up"), F.coalesce("n", zero).alias("n"),
            F.when(F.col("inner").isNull(), 1).otherwise(0).cast("long").alias("leaves"), (F.coalesce("g", zero) - F.coalesce("texts", zero)).alias("g"),
        ), "chain-sums")
        while waiting := state.filter("up IS NOT NULL").count():
            sent = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv")).agg(*(F.sum(c).alias(f"in_{c}") for c in ("n", "leaves", "g")), F.count("*").alias("rows"))
            took = state.join(sent, "conv", "left").select("conv", "above", "top", "up", *((F.col(c) + F.coalesce(f"in_{c}", zero)).alias(c) for c in ("n", "leaves", "g")), F.coalesce("rows", zero).alias("rows"))
            took = written(took, "chain-sums")
            next_up = took.filter("rows > 0").select(F.col("conv").alias("up"), F.col("up").alias("next"), "rows")
            moved = hot_join(took.filter("up IS NOT NULL").drop("rows"), next_up, ["up"], "rows", ["next"], waiting).withColumn("up", F.col("next")).drop("next")
            scratch.drop(state)
            state = written(moved.unionByName(took.filter("up IS NULL").drop("rows")), "chain-sums")
            scratch.drop(took)
        hung = state.filter("above IS NOT NULL").groupBy(F.col("above").alias("owner"), (F.col("top") - 1).alias("at"))
        return scratch.keep(hung.agg(F.count("*").alias("children"), F.sum("n").alias("n"), F.sum("leaves").alias("leaves"), F.sum("g").alias("g")), "hung")


def _ends(ended: DataFrame) -> DataFrame:
    """(owner, at, ends_sha256) of the nodes at which conversations end: digests of the lists of their ids.

    Lists are made in order by tasks that share them; what a task has of a list is one or some strings, and only these meet.
    """
    spark = ended.sparkSession

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, at, ids = (b[c].to_numpy() for c in ("owner", "at", "conv"))
            cuts = [0, *(np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] != at[:-1])) + 1).tolist(), b.num_rows]
            los = [lo for lo, hi in zip(cuts, cuts[1:]) if hi > lo]
            strings = [",".join(map(str, ids[lo:hi].tolist())) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[los], pa.int64()) for x in (owner, at, ids)), pa.array(strings, pa.string())], ["owner", "at", "conv", "list"])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for b in batches:
            out = []
            for owner, at, part in zip(b["owner"].to_pylist(), b["at"].to_pylist(), b["list"].to_pylist()):
                if (owner, at) != now:
                    if digest:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (owner, at), hashlib.sha256(part.encode())
                else:
                    digest.update(f",{part}".encode())
            yield _told(out)
        if digest:
            yield _told([(*now, digest.hexdigest())])

    parts = ended.repartitionByRange(partitions(spark), "owner", "at", "conv").sortWithinPartitions("owner", "at", "conv").select("owner", "at", "conv")
    lists = parts.mapInArrow(listed, "owner long, at long, conv long, list string")
    return lists.repartition("owner", "at").sortWithinPartitions("owner", "at", "conv").mapInArrow(hashed, "owner long, at long, ends_sha256 string")


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"owner": pa.int64(), "at": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def _nodes(own: DataFrame, at_node: DataFrame, hung: DataFrame, ends: DataFrame) -> DataFrame:
    """Sums along each chain from its end, and the report's columns."""
    zero = F.lit(0).cast("long")
    both = at_node.select("owner", "at", zero.alias("children"), "n", zero.alias("leaves"), "g").unionByName(hung)
    both = both.groupBy(F.col("owner").alias("conv"), F.col("at").alias("depth")).agg(*(F.sum(c).alias(c) for c in ("children", "n", "leaves", "g")))
    rows = own.join(both, ["conv", "depth"], "left").fillna(0, ["children", "n", "leaves", "g"])
    leaf = F.when((F.col("depth") == F.col("length")) & (F.col("children") == 0), 1).otherwise(0)
    rows = rows.withColumns({"leaves": F.col("leaves") + leaf, "g": F.col("g") - F.col("n_chars")})
    rows = scan(rows, "conv", [F.desc("depth")], ["n", "leaves", "g"], lambda d: written(d, "sums"), partitions(own.sparkSession))
    before: Column = F.col("upto") - F.col("n_chars")
    out = rows.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("above")).alias("parent_conv_id"),
        F.col("run_n").alias("n_convs"), (F.col("children") + (F.col("depth") < F.col("length")).cast("long")).alias("n_children"), F.col("run_leaves").alias("n_leaves"),
        (F.col("run_g") - F.col("run_n") * before).alias("saved_tokens"),
    )
    ends = ends.withColumnsRenamed({"owner": "conv_id", "at": "depth"})
    return out.join(ends, ["conv_id", "depth"], "left").fillna(hashlib.sha256(b"").hexdigest(), ["ends_sha256"])

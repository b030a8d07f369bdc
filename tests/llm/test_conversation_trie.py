from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keyhold.llm import conversation_trie, queries, registry
from tests.oracle import same, sql_rows

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def turns_of(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    return {k: tuple((x[2], x[4]) for x in sorted(v)) for k, v in by.items()}


def rebuilt(rows):
    own, out = turns_of(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, ())[:h] + turns[h:]
    return out


def brute(convs):
    """The definition, node by node."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += p not in children
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


def test_query_equals_sql_and_brute_force(spark):
    df = queries.op11_conversation_trie(spark, "/root/testdata/sf0.01")
    assert same(df.select(*COLUMNS), registry.ORACLE["op11_conversation_trie"], "/root/testdata/sf0.01") > 300
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert told(df) == brute(rebuilt(map(tuple, rows)))


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    """Chains on chains, copies, conversations that begin others, one with most turns, ties, nulls."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-50, 250), 60):
        for t in range(rng.choice([1, 2, 3, 9])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice(["a", "a", "bb", "", None, "é🤦"])))
    rows += [(500, t, "user", "a") for t in range(200)] + [(None, 1, "user", "a")]
    rows += [(c, t, "user", "a") for c in range(600, 640) for t in range(640 - c)]  # each a beginning of the one before
    rows += [(c, t, "user", "z") for c in range(700, 712) for t in range(c - 699)]  # each hangs on the one before
    rows += rows[:40]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), SCHEMA).repartition(5).withColumns({c: F.lit(7) for c in ("pos", "_hot", "depth", "conv", "sha")})
    assert told(conversation_trie.conversation_trie(df)) == brute(turns_of(rows))
    assert told(conversation_trie.rebuilt_trie(df)) == brute(rebuilt(rows))


def test_turnless_and_empty(spark):
    absent = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)  # its own first turns go, and no base gives others
    rows = [(absent, 0, "user", "a")]
    assert told(conversation_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rebuilt(rows))
    assert told(conversation_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA))) == []
    assert told(conversation_trie.conversation_trie(spark.createDataFrame([(None, 0, "user", "a")], SCHEMA))) == []


def test_crc_in_sql():
    names, rows = sql_rows(f"SELECT c, {registry._CRC} AS crc FROM (VALUES (0::BIGINT), (-7), (123456789)) v(c)")
    assert all(crc == zlib.crc32(str(c).encode()) for c, crc in rows)

"""The window's operators against a plain simulator and against SQL."""

from __future__ import annotations

import glob
import os
import random
from collections import OrderedDict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyhold import WindowConfig
from keyhold import operators as ops
from keyhold.functions import sightings
from keyhold.operators import chunks, pieces
from keyhold.plans import KeyWindow
from keyhold.plans import queries as q
from keyhold.plans.table_function import register
from keyhold.sources import StaleWindowError
from tests.oracle import same

SCHEMA = "key string, t long, tie long"


def last_with_capacity_join(sighted: DataFrame, span: int | None, capacity: int) -> DataFrame:
    """``last`` with a capacity as a range self-join; for checks at small scale.

    A key is lost by its own age, or by ``capacity`` other keys that were seen since: with refreshing, what is dropped
    is always what was seen longest ago.
    """
    numbered = sighted.withColumn("i", F.row_number().over(Window.orderBy("t", "tie")))
    w = Window.partitionBy("key").orderBy("i")
    o = numbered.withColumns({"p": F.lag("i").over(w), "pt": F.lag("t").over(w)})
    other = o.select(F.col("i").alias("bi"), F.coalesce("p", F.lit(0)).alias("bp"))
    between = (F.col("bi") > F.col("p")) & (F.col("bi") < F.col("i")) & (F.col("bp") <= F.col("p"))
    lost = F.count("bi") >= capacity
    old = F.lit(False) if span is None else F.first(F.col("t") - F.col("pt")) > span
    return o.join(other, between, "left").groupBy("key", "t", "tie").agg((F.first("p").isNull() | old | lost).alias("admitted"))


def simulate(rows, c: WindowConfig):
    held, out = OrderedDict(), {}
    for k, t, tie in sorted(rows, key=lambda r: r[1:]):
        for x in [x for x, a in held.items() if c.span_us is not None and t - a > c.span_us]:
            del held[x]
        new = k not in held
        if not new and c.policy == "last":
            held[k] = t
            held.move_to_end(k)
        if new and c.capacity is not None and len(held) >= c.capacity:
            if c.policy == "refuse":
                new = False
            else:
                held.popitem(last=False)
        if new:
            held[k] = t
        out[tie] = new
    return out, held


CONFIGS = [WindowConfig(s, c, p) for p in ("first", "last", "refuse") for s, c in ((3, None), (0, None), (None, None), (4, 2), (None, 1), (50, 3))]
rows_of = st.lists(st.tuples(st.sampled_from(["", "a", "ä", "b", "c"]), st.integers(0, 30)), max_size=40).map(lambda x: [(k, t, i) for i, (k, t) in enumerate(x)])


@pytest.fixture
def large(monkeypatch):
    """Tables count as too large for a task, and chunks are small."""
    monkeypatch.setattr(pieces, "TASK_BYTES", -1)
    monkeypatch.setattr(chunks, "CHUNK_ROWS", 9)
    monkeypatch.setattr(chunks, "CHUNK_SHARE", 1)


@pytest.mark.parametrize("policy", ["first", "last", "refuse"])
@pytest.mark.parametrize("span,capacity", [(4, 2), (None, 1), (50, 3), (2, 9)])
def test_chunks_of_time(spark, large, policy, span, capacity):
    """Windows with a capacity, folded by chunks: marks, and why keys leave; one key has two thirds of the rows."""
    c = WindowConfig(span, capacity, policy)
    rows = [("a" if i % 3 else "bcdefg"[i * 5 % 6], i * i % 61, i) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, held = simulate(rows, c)
    got = ops.departures(df, c).collect()
    assert {r.tie: r.admitted for r in got} == want and len(got) == len(rows)
    fold = chunks.WindowFold(c)
    ordered = sorted(rows, key=lambda r: r[1:])
    one = fold.rows([r[0] for r in ordered], [r[1] for r in ordered])
    assert sorted((r.tie, r.expired, r.evicted) for r in got) == sorted(zip((r[2] for r in ordered), one[1].tolist(), one[2].tolist()))
    same_time = df.withColumn("t", F.lit(7).cast("long"))
    assert {r.tie: r.admitted for r in ops.admit(same_time, c).collect()} == simulate([(k, 7, i) for k, _, i in rows], c)[0]


def test_chunks_after_gaps_need_no_second_round(spark, large, monkeypatch):
    """Where gaps longer than the span lie between chunks, each is worked through once to see what it leaves."""
    rows = [(f"k{i % 7}", i // 9 * 1000 + i % 9, i) for i in range(90)]
    rounds = []
    whole = chunks.settled
    monkeypatch.setattr(chunks, "settled", lambda df: rounds.append(1) or whole(df))
    c = WindowConfig(100, 3)
    got = ops.admit(spark.createDataFrame(rows, SCHEMA), c).collect()
    assert {r.tie: r.admitted for r in got} == simulate(rows, c)[0]
    assert len(rounds) <= 4  # the rows, one round of states, and what the sampled bounds cut inside a run


@pytest.mark.parametrize("policy", ["first", "last", "refuse"])
def test_no_task_folds_more_than_a_chunk(spark, monkeypatch, policy):
    """Of a table of few bytes but more rows than a chunk, too, and where differences between guesses never die out."""
    monkeypatch.setattr(chunks, "CHUNK_ROWS", 40)
    monkeypatch.setattr(chunks, "CHUNK_SHARE", 1)
    classic = type(spark.range(1))
    tasks, whole = [], classic.mapInArrow

    def counted(df, *args, **kwargs):
        tasks.append(df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] or 0)
        return whole(df, *args, **kwargs)

    monkeypatch.setattr(classic, "mapInArrow", counted)
    rows = [(f"k{i % 3}", i, i) for i in range(200)]  # without gaps, so that keys keep their phase
    c = WindowConfig(7, 5, policy)
    got = ops.admit(spark.createDataFrame(rows, SCHEMA), c).collect()
    assert {r.tie: r.admitted for r in got} == simulate(rows, c)[0] and len(got) == len(rows)
    assert max(tasks) <= 2 * 40 + 5  # bounds are sampled; and the state before a chunk


@pytest.mark.parametrize("config", [WindowConfig(s, None, p) for s in (0, 5, 700, None) for p in ("first", "last")])
@pytest.mark.parametrize("tasks", [4, 70])
def test_hot_key_over_pieces(spark, large, config, tasks):
    """One key has nine rows of ten, over many pieces; rows repeat, and times lie on both sides of 1970."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)  # beyond 32 pieces, functions are put together in groups
    try:
        rows = [("hot" if i % 10 else f"k{i % 30}", (i * i * 37) % 4001 - 2000, i) for i in range(400)]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert {r.tie: r.admitted for r in ops.admit(df, config).collect()} == simulate(rows, config)[0]
        twice = ops.admit(df.unionByName(df), config).filter("admitted")
        assert sorted(r.tie for r in twice.collect()) == sorted(i for i, a in simulate(rows, config)[0].items() if a)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("step,span", [(1, 50), (7, 100), (1, 5000)])
def test_periodic_key(spark, large, step, span):
    """Without a gap, and so regular that what an anchor leads to never comes together."""
    rows = [("a", i * step, i) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.tie: r.admitted for r in ops.admit(df, WindowConfig(span)).collect()} == simulate(rows, WindowConfig(span))[0]


def test_piece_functions():
    """A piece's function gives what the rows give, for every anchor; and so do pieces put together."""
    rng = random.Random(5)
    for span in (0, 3, 20, None):
        rule = pieces.FirstSighting(span)
        times = [sorted(rng.choices(range(i * 30, i * 30 + 30), k=rng.randrange(1, 12))) for i in range(4)]
        parts = []
        for t in times:
            upto, exits, fresh = rule.exits({"t": np.array(t)})
            parts.append(pieces.Piece("a", "a", True, upto, exits, fresh, None))
        joined = parts[0].then(rule, parts[1]).then(rule, parts[2].then(rule, parts[3]))
        for anchor in [None, *range(-25, times[0][0] + 1)]:
            at, want = anchor, []
            for t in (x for part in times for x in part):
                if at is None or span is not None and t - at > span:
                    at = t
            assert joined.of(rule, "a", anchor) == at, (span, anchor)


@pytest.mark.parametrize("most", [1, 3, 50])
def test_reuse_distance(spark, most, request):
    rows = [(rng.choice("abcdefghij"), t, t) for rng in [random.Random(most)] for t in range(120)]
    want = {}
    for k, t, i in rows:
        p = max((s for x, s, _ in rows[:i] if x == k), default=None)
        d = None if p is None else len({x for x, s, _ in rows[:i] if s > p})
        want[i] = (None, None) if d is None or d >= most else (d, t - p)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.tie: (r.distance, r.age) for r in ops.reuse_distance(df, most).collect()} == want
    request.getfixturevalue("large")
    got = ops.reuse_distance(df, most)
    assert {r.tie: (r.distance, r.age) for r in got.collect()} == want
    for c in range(1, most + 1):
        assert {r.tie: r.a for r in got.select("tie", ops.admitted_at(c, 9).alias("a")).collect()} == simulate(rows, WindowConfig(9, c, "last"))[0]
        if c == 3:
            break
    assert ops.reuse_distance(df.limit(0), most).count() == 0


@pytest.mark.parametrize("config", [WindowConfig(5), WindowConfig(5, None, "last"), WindowConfig(None)])
def test_seen_asof(spark, config, request):
    rows = [("a" if i % 4 else "bc"[i % 8 // 4], i * i % 97, i) for i in range(60)]
    probes = [(k, t, f"{k}{t}") for k in ("a", "b", "c", "z", None) for t in (-1, 0, 5, 33, 34, 96, 200, None)]
    want = {}
    for k, t, name in probes:
        # the window as it was at t; a later sighting of another key would only drop what is too old
        _, held = simulate([r for r in rows if t is not None and r[1] <= t], config)
        want[name] = k in held and (config.span_us is None or t - held[k] <= config.span_us)
    df, probe = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(probes, "key string, t long, anchor string").withColumn("anchors", F.lit(1))
    assert {r.anchor: r.seen for r in ops.seen_asof(probe, df, config).collect()} == want
    request.getfixturevalue("large")
    got = ops.seen_asof(probe, df.repartition(3), config)
    assert {r.anchor: r.seen for r in got.collect()} == want and got.columns == [*probe.columns, "seen"]
    with pytest.raises(ValueError):
        ops.seen_asof(probe, df, WindowConfig(5, 2))


@pytest.mark.parametrize("config", [WindowConfig(10), WindowConfig(10, None, "last"), WindowConfig(10, 3, "refuse"), WindowConfig(10, 2), WindowConfig(None, 2, "last")])
def test_late_rows_and_the_law_of_counts(spark, config):
    """However the deliveries are cut: what comes late changes nothing, and admitted = retained + expired + evicted."""
    rng = random.Random(str(config))
    rows = [(rng.choice("abcde"), rng.randrange(100), i) for i in range(40)]
    w, on_time, clock = KeyWindow(config), [], None
    for call in (rows[:15], rows[15:16], [], rows[16:]):
        call = sorted(call, key=lambda r: r[1])[: 15 if len(call) > 20 else None]
        got = {r.tie: (r.admitted, r.late) for r in w.observe(spark.createDataFrame(call, SCHEMA), "key", "t", "tie").collect()}
        fit = [r for r in call if clock is None or r[1] >= clock]
        on_time += fit
        # of equal times, what was delivered first comes first
        order = {i: n for n, (_, _, i) in enumerate(on_time)}
        marks, held = simulate([(k, t, order[i]) for k, t, i in on_time], config)
        assert got == {i: (marks[order[i]], False) if (k, t, i) in fit else (None, True) for k, t, i in call}
        clock = max([t for _, t, _ in fit] + [clock or 0])
        s = w.stats(spark).first()
        assert s.admitted == s.retained + s.expired + s.evicted == sum(marks.values())
        assert s.repeats == len(marks) - sum(marks.values()) and w.counts["late"] == sum(c for c in (w.counts["late"],))
        live = [k for k, a in held.items() if config.span_us is None or clock - a <= config.span_us]
        assert sorted(r.key for r in w.keys().collect()) == sorted(live)


def test_fresh_window(spark, tmp_path):
    """Every method works before the first sighting, on a folder that isn't there."""
    path = str(tmp_path / "new")
    w = KeyWindow.open(spark, path, WindowConfig(10))
    probe = spark.createDataFrame([("a",), (None,)], "key string")
    assert w.keys().count() == 0 and [r.seen for r in w.seen(probe, "key").collect()] == [False, False]
    assert w.advance(5).first().dropped == 0 and tuple(w.stats(spark).first()) == (10, None, 0, 0, 0, 0, 0)
    assert w.save(path) == 1
    v = KeyWindow.open(spark, path)
    assert v.config == WindowConfig(10) and v.clock == 5 and v.keys().count() == 0
    late = v.observe(spark.createDataFrame([("a", 4, 1), ("b", 5, 2)], SCHEMA), "key", "t", "tie")
    assert {r.key: (r.admitted, r.late) for r in late.collect()} == {"a": (None, True), "b": (True, False)}
    with pytest.raises(ValueError):
        KeyWindow.open(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        v.load(spark, str(tmp_path / "none"))


def test_seen_at_an_asked_time(spark):
    w = KeyWindow(WindowConfig(10, None, "last"))
    w.observe(spark.createDataFrame([("a", 1, 1), ("b", 8, 2)], SCHEMA), "key", "t", "tie")
    probe = spark.createDataFrame([("a",), ("b",)], "key string")
    assert [{r.key: r.seen for r in w.seen(probe, "key", now).collect()} for now in (None, 12, 19)] == [{"a": True, "b": True}, {"a": False, "b": True}, {"a": False, "b": False}]


def test_two_savers(spark, tmp_path):
    """The second of two that began from the same version gets an error, and the first one's sightings stay."""
    path = str(tmp_path / "state")
    KeyWindow.open(spark, path, WindowConfig(10)).save(path)
    one, two = KeyWindow.open(spark, path), KeyWindow.open(spark, path)
    one.observe(spark.createDataFrame([("a", 1, 1)], SCHEMA), "key", "t", "tie")
    two.observe(spark.createDataFrame([("b", 1, 1)], SCHEMA), "key", "t", "tie")
    assert one.save(path) == 2
    with pytest.raises(StaleWindowError):
        two.save(path)
    with pytest.raises(StaleWindowError):
        KeyWindow(WindowConfig(10)).save(path)
    assert [r.key for r in KeyWindow.open(spark, path).keys().collect()] == ["a"] and one.save(path) == 3
    # one that broke off while it wrote its entry: left out, and its number isn't used again
    (tmp_path / "state/manifest/v4.json").write_text('{"version": 4, "sp')
    assert KeyWindow.open(spark, path).versions == {path: 3} and one.save(path) == 5


def test_changed_contents(spark, tmp_path):
    path = str(tmp_path / "state")
    w = KeyWindow(WindowConfig(10))
    w.observe(spark.createDataFrame([("a", 1, 1), ("b", 5, 2)], SCHEMA), "key", "t", "tie")
    w.save(path)
    (folder,) = glob.glob(f"{path}/contents/*")
    rows = spark.createDataFrame(spark.read.parquet(folder).collect(), "key string, anchor long, tie long")
    rows.withColumn("anchor", F.col("anchor") + 1).write.mode("overwrite").parquet(folder)
    with pytest.raises(ValueError, match="damaged"):
        w.load(spark, path)


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_of)
def test_policies(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CONFIGS:
        want, held = simulate(rows, c)
        assert {r.tie: r.admitted for r in ops.admit(df, c).collect()} == want, c
        now = max((t for _, t, _ in rows), default=0)
        live = [k for k, a in held.items() if c.span_us is None or now - a <= c.span_us]
        got = ops.retained_keys(ops.snapshot(df, c)).collect()
        assert sorted(r.key for r in got) == sorted(live), c
        if c.capacity is None:
            assert [r.key for r in got] == live, c
    got = {r.tie: r.admitted for r in last_with_capacity_join(df, 4, 2).collect()}
    assert got == simulate(rows, WindowConfig(4, 2, "last"))[0]


@pytest.mark.parametrize("name", q.QUERIES)
def test_sql(spark, name):
    assert same(q.QUERIES[name](spark, "/root/testdata/sf0.001"), q.ORACLE[name]) >= 1


def test_clashing_names_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, 1, 9), (None, 2, 2, 9), ("a", 2, 3, 9)], "admitted string, _before long, _run long, t long")
    got = ops.admit(sightings(df, "admitted", "_before", "_run"), WindowConfig(5))
    assert sorted((r.key, r.admitted) for r in got.collect()) == [("a", False), ("a", True)]
    with pytest.raises(TypeError):
        sightings(df, "t", "admitted", "_run")


def test_save_load_advance(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1), ("b", 5, 2), ("c", 9, 3)], SCHEMA)
    w = KeyWindow(WindowConfig(10))
    assert w.observe(df, "key", "t", "tie").filter("admitted").count() == 3
    path = str(tmp_path / "state")
    assert (w.save(path), w.save(path)) == (1, 2)
    v = KeyWindow.open(spark, path)
    assert [r.key for r in v.keys().collect()] == ["a", "b", "c"]
    more = spark.createDataFrame([("a", 12, 4), ("b", 13, 5)], SCHEMA)
    assert {r.key: r.admitted for r in v.observe(more, "key", "t", "tie").collect()} == {"a": True, "b": False}
    assert v.advance(16).first().dropped == 1 and v.advance(16).first().dropped == 0 and v.clock == 16
    assert {r.key: r.seen for r in v.seen(more, "key").collect()} == {"a": True, "b": False}
    [os.remove(p) for p in glob.glob(f"{path}/contents/version=2-*/*.parquet")[:1]]
    with pytest.raises(Exception):  # noqa: B017
        w.load(spark, path)
    assert [r.key for r in w.keys().collect()] == ["a", "b", "c"]  # as before the failed load


@pytest.mark.parametrize("policy", ["first", "last"])
def test_stats_span_and_capacity(spark, tmp_path, policy):
    """a is evicted by c, b and c expire at 20; d stays."""
    rows = [("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("c", 3, 4), ("d", 20, 5)]
    c, want = WindowConfig(5, 2, policy), (5, 2, 1, 4, 2, 1, 1)
    assert tuple(ops.stats(spark.createDataFrame(rows, SCHEMA), c).first()) == want
    assert tuple(ops.stats(spark.createDataFrame([], SCHEMA), c).first()) == (5, 2, 0, 0, 0, 0, 0)
    w, path = KeyWindow(c), str(tmp_path / "state")
    assert tuple(w.stats(spark).first()) == (5, 2, 0, 0, 0, 0, 0)
    w.observe(spark.createDataFrame(rows[:3], SCHEMA), "key", "t", "tie")
    assert tuple(w.stats(spark).first()) == (5, 2, 2, 3, 0, 1, 0)
    w.save(path)
    v = KeyWindow.open(spark, path)
    v.observe(spark.createDataFrame(rows[3:], SCHEMA), "key", "t", "tie")
    assert tuple(v.stats(spark).first()) == want
    v.advance(30)
    assert tuple(v.stats(spark).first()) == (5, 2, 0, 4, 3, 1, 1)




def test_table_function(spark):
    register(spark)
    rows = [("ab"[i % 2], i * i % 37, i) for i in range(40)] + [(None, 1, 90), ("a", None, 91)]
    spark.createDataFrame(rows, "`my key` string, t long, tie long").createOrReplaceTempView("some_rows")
    for c in (WindowConfig(9), WindowConfig(9, None, "last"), WindowConfig(20, 1), WindowConfig(None, 1, "refuse"), WindowConfig(None)):
        bounds = ", ".join("NULL" if x is None else str(x) for x in (c.span_us, c.capacity))
        got = spark.sql(f"SELECT * FROM keyhold_observe(TABLE(some_rows), 'my key', 't', 'tie', {bounds}, '{c.policy}')")
        assert {r.tie: r.admitted for r in got.collect()} == simulate([r for r in rows if r[2] < 90], c)[0]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM keyhold_observe(TABLE(some_rows), 'k', 't', 'tie', 9, NULL, 'first')").collect()
    with pytest.raises(Exception, match="capacity"):
        spark.sql("SELECT * FROM keyhold_observe(TABLE(some_rows), 'my key', 't', 'tie', 9, 0, 'first')").collect()

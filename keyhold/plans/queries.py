"""The window's registered queries and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyhold import operators as ops
from keyhold.config import WindowConfig
from keyhold.functions import epoch_micros, sightings
from keyhold.plans.table_function import NAME, register
from keyhold.plans.window import KeyWindow
from keyhold.sources import folder
from keyhold.sources.state import delete, settled, shared_folder
from keyhold.streaming.observe import PROVIDER, ROCKSDB, admit_stream, bucket_us

HOUR, DAY = 3_600_000_000, 86_400_000_000
PAUSE = 1_706_400_000_000_000
CALLS = (1_704_900_000_000_000, 1_705_700_000_000_000)
CAPACITIES = (20, 50, 120)
Query = Callable[[SparkSession, str], DataFrame]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "o_orderdate", "o_orderkey")


def _marked(table: Callable[[SparkSession, str], DataFrame], config: WindowConfig) -> Query:
    return lambda spark, sf_dir: ops.admit(table(spark, sf_dir), config).select(F.col("tie").alias("row_id"), "key", "admitted")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")


HELD = WindowConfig(DAY, None, "last")


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.snapshot(events(spark, sf_dir), HELD)


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.retained_keys(_held(spark, sf_dir))


def _advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    held = ops.snapshot(rows, WindowConfig(None, None, "last"))
    return ops.advance(held, HELD, PAUSE)[1]


def _stats(policy: str, span: int | None, capacity: int | None) -> Query:
    return lambda spark, sf_dir: ops.stats(events(spark, sf_dir), WindowConfig(span, capacity, policy))



def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three calls by time; every fifth event is delivered a call late."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = epoch_micros(rows, "ts")
    call = F.when(t <= CALLS[0], 0).when(t <= CALLS[1], 1).otherwise(2) + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    window, out = KeyWindow(WindowConfig(HOUR)), []
    for n in range(4):
        out.append(window.observe(rows.filter(call == n), "user_id", "ts", "event_id"))
    return reduce(DataFrame.unionByName, out).select(F.col("tie").alias("row_id"), "key", "admitted", "late")


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window on a folder that isn't there yet, filled, saved and opened anew: its keys."""
    path = f"{shared_folder(spark)}/window-{uuid.uuid4().hex}"
    window = KeyWindow.open(spark, path, HELD)
    window.observe(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id")
    window.save(path)
    kept = settled(KeyWindow.open(spark, path).keys())
    delete(spark, path)
    return kept


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that the window holds, asked half a day after its last sighting."""
    window = KeyWindow(HELD)
    window.observe(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id")
    return window.seen(_customers(spark, sf_dir), "c_custkey", window.clock + DAY // 2)


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer the window holds, half a day after its last sighting; a sketch by hours prunes them before the join."""
    window = KeyWindow(HELD)
    window.observe(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id")
    probe = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return window.seen(probe, "o_custkey", window.clock + DAY // 2, window.sketch(HOUR))


def _folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a window saved, read as a table, written as a table to another folder and opened from there: its contents."""
    folder.register(spark)
    one, two = (f"{shared_folder(spark)}/window-{uuid.uuid4().hex}" for _ in range(2))
    window = KeyWindow(HELD)
    window.observe(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts", "event_id")
    window.save(one)
    rows = spark.read.format(folder.NAME).load(one)
    rows.write.format(folder.NAME).mode("overwrite").options(span_us=DAY, policy="last", clock=window.clock).save(two)
    kept = settled(KeyWindow.open(spark, two).held)
    delete(spark, one)
    delete(spark, two)
    return kept


def _asof(policy: str) -> Query:
    """For each event, whether the window held the next user at that time."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/events.parquet")
        probe = rows.select("event_id", (F.col("user_id") + 1).alias("asked"), epoch_micros(rows, "ts").alias("at"))
        return ops.seen_asof(probe, events(spark, sf_dir), WindowConfig(2 * HOUR, None, policy), "asked", "at")

    return run


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What refreshing windows of three capacities admit, in one pass."""
    rows = ops.reuse_distance(events(spark, sf_dir), max(CAPACITIES))
    return rows.select(F.col("tie").alias("row_id"), "key", "distance", *(ops.admitted_at(c, DAY).alias(f"admitted_{c}") for c in CAPACITIES))


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of one batch: what its watermark has passed in the end."""
    path = f"{sf_dir}/events.parquet"
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace("events.parquet", "events*.parquet"))
    rows = rows.select(F.col("user_id").cast("string").alias("key"), F.timestamp_micros(epoch_micros(rows, "ts")).alias("ts"), F.col("event_id").alias("tie"))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        sink = admit_stream(rows, WindowConfig(HOUR)).writeStream.format("parquet").option("path", f"{at}/rows")
        sink.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    out = settled(spark.read.parquet(f"{at}/rows").select(F.col("tie").alias("row_id"), "key", "admitted", "late"))
    delete(spark, at)
    return out


def _in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    view = f"events_{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.col("user_id").cast("string").alias("key")).createTempView(view)
    return spark.sql(f"SELECT event_id AS row_id, key, admitted FROM {NAME}(TABLE({view}), 'key', 'ts', 'event_id', {HOUR}, NULL, 'first')")


def _resumed(spark: SparkSession, sf_dir: str) -> tuple[KeyWindow, DataFrame]:
    """Observe the events up to a moment, save, open what was saved, and observe the rest: the window and all marks."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    late = epoch_micros(rows, "ts") > PAUSE
    path = f"{shared_folder(spark)}/window-{uuid.uuid4().hex}"
    one = KeyWindow(WindowConfig(HOUR))
    before = one.observe(rows.filter(~late), "user_id", "ts", "event_id")
    one.save(path)
    two = KeyWindow.open(spark, path)
    two.held = settled(two.held)
    delete(spark, path)
    after = two.observe(rows.filter(late), "user_id", "ts", "event_id")
    return two, before.unionByName(after)


def _resumed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumed(spark, sf_dir)[1].select(F.col("tie").alias("row_id"), "key", "admitted")


def _resumed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumed(spark, sf_dir)[0].stats(spark)


QUERIES: dict[str, Query] = {
    "observe_first": _marked(events, WindowConfig(HOUR)),
    "observe_last": _marked(events, WindowConfig(HOUR, None, "last")),
    "observe_first_cap": _marked(events, WindowConfig(DAY, 120)),
    "observe_last_cap": _marked(events, WindowConfig(DAY, 120, "last")),
    "observe_refuse": _marked(events, WindowConfig(DAY, 120, "refuse")),
    "observe_unbounded": _marked(events, WindowConfig()),
    "orders_boundary_first": _marked(orders, WindowConfig(30 * DAY)),
    "orders_boundary_last": _marked(orders, WindowConfig(30 * DAY, None, "last")),
    "seen_flag": lambda s, d: ops.flag_seen(_customers(s, d), _held(s, d), "c_custkey"),
    "seen_semi": lambda s, d: ops.seen_only(_customers(s, d), _held(s, d), "c_custkey"),
    "unseen_anti": lambda s, d: ops.unseen_only(_customers(s, d), _held(s, d), "c_custkey"),
    "advance_count": _advance,
    "keys_snapshot": _keys,
    "stats_span": _stats("first", HOUR, None),
    "stats_capacity": _stats("last", None, 120),
    "stats_span_capacity": _stats("first", DAY, 120),
    "stats_last_span_capacity": _stats("last", DAY, 120),
    "window_resumed": _resumed_marks,
    "window_resumed_stats": _resumed_stats,
    "window_late": _late,
    "window_fresh": _fresh,
    "seen_asked": _asked,
    "seen_pruned": _pruned,
    "window_folder": _folder,
    "seen_asof": _asof("last"),
    "seen_asof_first": _asof("first"),
    "reuse_distance": _distances,
    "stream_first": _streamed,
    "sql_observe": _in_sql,
}

EV = "ev AS (SELECT row_number() OVER (ORDER BY ts, event_id) i, event_id row_id, epoch_us(ts) t, user_id::VARCHAR k FROM events)"
ORD = "ev AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) i, o_orderkey row_id, epoch_us(o_orderdate) t, o_custkey::VARCHAR k FROM orders)"
MARK = "SELECT ev.row_id, ev.k AS key, a.i IS NOT NULL AS admitted FROM ev LEFT JOIN adm a USING (i)"


def last_sql(table: str, span: int | None) -> str:
    old = "" if span is None else f" OR t - pt > {span}"
    return f"WITH {table}, o AS (SELECT *, lag(t) OVER (PARTITION BY k ORDER BY i) pt FROM ev), adm AS (SELECT i FROM o WHERE pt IS NULL{old}) {MARK}"


def first_sql(table: str, span: int) -> str:
    return f"""WITH RECURSIVE {table}, o AS (SELECT i, t, k, row_number() OVER (PARTITION BY k ORDER BY i) rn FROM ev),
 r AS (SELECT k, rn, i, t a, true adm FROM o WHERE rn = 1 UNION ALL
  SELECT o.k, o.rn, o.i, CASE WHEN o.t - r.a > {span} THEN o.t ELSE r.a END, o.t - r.a > {span} FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1),
 adm AS (SELECT i FROM r WHERE adm) {MARK}"""


def last_cap_sql(table: str, span: int, cap: int) -> str:
    return f"""WITH {table}, o AS (SELECT i, t, k, lag(t) OVER w pt, lag(i) OVER w p FROM ev WINDOW w AS (PARTITION BY k ORDER BY i)),
 s AS (SELECT a.i, a.p, a.t, a.pt, count(b.i) dist FROM o a LEFT JOIN o b ON b.i > a.p AND b.i < a.i AND coalesce(b.p, 0) <= a.p GROUP BY ALL),
 adm AS (SELECT i FROM s WHERE p IS NULL OR t - pt > {span} OR dist >= {cap}) {MARK}"""


def capped_sql(table: str, span: int, cap: int, refuse: bool) -> str:
    room = f" AND len(r.ks[p:]) < {cap}" if refuse else ""
    kept = lambda x: x if refuse else f"{x}[greatest(1, len({x}) - {cap} + 2):]"
    return f"""WITH RECURSIVE {table}, r AS (SELECT i, k, true adm, [k] ks, [t] tt FROM ev WHERE i = 1 UNION ALL
 SELECT i, k, adm, CASE WHEN adm THEN list_append({kept('ks2')}, k) ELSE ks2 END, CASE WHEN adm THEN list_append({kept('tt2')}, t) ELSE tt2 END
 FROM (SELECT e.i, e.k, e.t, NOT list_contains(r.ks[p:], e.k){room} adm, r.ks[p:] ks2, r.tt[p:] tt2
  FROM (SELECT r.*, 1 + len(list_filter(r.tt, lambda x: e.t - x > {span})) p FROM r JOIN ev e ON e.i = r.i + 1) r JOIN ev e ON e.i = r.i + 1)),
 adm AS (SELECT i FROM r WHERE adm) {MARK}"""


def distances_sql(table: str, span: int, caps: tuple[int, ...]) -> str:
    marks = ", ".join(f"p IS NULL OR t - pt > {span} OR dist >= {c} AS admitted_{c}" for c in caps)
    return f"""WITH {table}, o AS (SELECT i, row_id, t, k, lag(t) OVER w pt, lag(i) OVER w p FROM ev WINDOW w AS (PARTITION BY k ORDER BY i)),
 s AS (SELECT a.i, a.row_id, a.k, a.p, a.t, a.pt, count(b.i) dist FROM o a LEFT JOIN o b ON b.i > a.p AND b.i < a.i AND coalesce(b.p, 0) <= a.p GROUP BY ALL)
SELECT row_id, k AS key, CASE WHEN p IS NOT NULL AND dist < {max(caps)} THEN dist END AS distance, {marks} FROM s"""


def asof_sql(span: int, anchors: str) -> str:
    return f"""WITH {anchors} SELECT e.event_id, e.user_id + 1 AS asked, epoch_us(e.ts) AS at, coalesce(epoch_us(e.ts) - a.t <= {span}, false) AS seen
FROM events e ASOF LEFT JOIN anchors a ON a.k = (e.user_id + 1)::VARCHAR AND epoch_us(e.ts) >= a.t"""


def stats_capped_sql(table: str, span: int, cap: int) -> str:
    """``first`` with both bounds; x: keys too old at this sighting, v: keys dropped for want of room."""
    kept = lambda x: f"{x}[greatest(1, len({x}) - {cap} + 2):]"
    return f"""WITH RECURSIVE {table}, r AS (SELECT i, k, true adm, [k] ks, [t] tt, 0 x, 0 v FROM ev WHERE i = 1 UNION ALL
 SELECT i, k, adm, CASE WHEN adm THEN list_append({kept('ks2')}, k) ELSE ks2 END, CASE WHEN adm THEN list_append({kept('tt2')}, t) ELSE tt2 END,
  x, CASE WHEN adm AND len(ks2) >= {cap} THEN 1 ELSE 0 END
 FROM (SELECT e.i, e.k, e.t, NOT list_contains(r.ks[p:], e.k) adm, r.ks[p:] ks2, r.tt[p:] tt2, p - 1 x
  FROM (SELECT r.*, 1 + len(list_filter(r.tt, lambda x: e.t - x > {span})) p FROM r JOIN ev e ON e.i = r.i + 1) r JOIN ev e ON e.i = r.i + 1))
 SELECT {span}::BIGINT AS span, {cap}::BIGINT AS capacity, (SELECT len(ks) FROM r ORDER BY i DESC LIMIT 1)::BIGINT AS retained, count(*) FILTER (adm)::BIGINT AS admitted,
 sum(x)::BIGINT AS expired, sum(v)::BIGINT AS evicted, count(*) FILTER (NOT adm)::BIGINT AS repeats FROM r"""


def stats_last_capped_sql(table: str, span: int, cap: int) -> str:
    """``last`` with both bounds; e: sightings after which so many other keys came within the span that their key was dropped."""
    return f"""WITH m AS ({last_cap_sql(table, span, cap)}), {table},
 o AS (SELECT i, t, k, lag(i) OVER w p, lead(i) OVER w nx FROM ev WINDOW w AS (PARTITION BY k ORDER BY i)),
 e AS (SELECT a.i FROM o a JOIN o b ON b.i > a.i AND b.t <= a.t + {span} AND b.i < coalesce(a.nx, 9e15) AND coalesce(b.p, 0) <= a.i GROUP BY 1 HAVING count(*) >= {cap}),
 l AS (SELECT t FROM o WHERE nx IS NULL ORDER BY i DESC LIMIT {cap}),
 c AS (SELECT (SELECT count(*) FROM l WHERE (SELECT max(t) FROM ev) - t <= {span})::BIGINT AS retained, (SELECT count(*) FROM e)::BIGINT AS evicted,
  count(*) FILTER (admitted)::BIGINT AS admitted, count(*) FILTER (NOT admitted)::BIGINT AS repeats FROM m)
 SELECT {span}::BIGINT AS span, {cap}::BIGINT AS capacity, retained, admitted, admitted - retained - evicted AS expired, evicted, repeats FROM c"""


_ALL_HELD = "l AS (SELECT user_id::VARCHAR AS key, max(epoch_us(ts)) anchor, max_by(event_id, ts) tie FROM events GROUP BY 1)"
_NOW_HELD = f"{_ALL_HELD}, held AS (SELECT * FROM l WHERE (SELECT max(epoch_us(ts)) FROM events) - anchor <= {DAY})"
_ADM1 = first_sql(EV, HOUR)

ORACLE: dict[str, str] = {
    "observe_first": _ADM1,
    "observe_last": last_sql(EV, HOUR),
    "observe_first_cap": capped_sql(EV, DAY, 120, False),
    "observe_last_cap": last_cap_sql(EV, DAY, 120),
    "observe_refuse": capped_sql(EV, DAY, 120, True),
    "observe_unbounded": last_sql(EV, None),
    "orders_boundary_first": first_sql(ORD, 30 * DAY),
    "orders_boundary_last": last_sql(ORD, 30 * DAY),
    "seen_flag": f"WITH {_NOW_HELD} SELECT c_custkey, c_name, c_custkey::VARCHAR IN (SELECT key FROM held) AS seen FROM customer",
    "seen_semi": f"WITH {_NOW_HELD} SELECT c_custkey, c_name FROM customer WHERE c_custkey::VARCHAR IN (SELECT key FROM held)",
    "unseen_anti": f"WITH {_NOW_HELD} SELECT c_custkey, c_name FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT key FROM held)",
    "advance_count": f"WITH {_ALL_HELD} SELECT count(*) FILTER (1706400000000000 - anchor > {DAY})::BIGINT AS dropped FROM l",
    "keys_snapshot": f"WITH {_NOW_HELD} SELECT key FROM held ORDER BY anchor, tie",
    "stats_span": f"""WITH m AS ({_ADM1.replace('ev.k AS key', 'ev.t, ev.k AS key')}), k AS (SELECT key, max(t) a FROM m WHERE admitted GROUP BY 1)
 SELECT {HOUR}::BIGINT AS span, NULL::BIGINT AS capacity, (SELECT count(*) FROM k WHERE (SELECT max(t) FROM m) - a <= {HOUR})::BIGINT AS retained,
 count(*) FILTER (admitted)::BIGINT AS admitted, (count(*) FILTER (admitted) - (SELECT count(*) FROM k WHERE (SELECT max(t) FROM m) - a <= {HOUR}))::BIGINT AS expired,
 0::BIGINT AS evicted, count(*) FILTER (NOT admitted)::BIGINT AS repeats FROM m""",
    "stats_capacity": f"""WITH m AS ({last_cap_sql(EV, 10**18, 120)}), k AS (SELECT least(120, count(DISTINCT key)) n FROM m)
 SELECT NULL::BIGINT AS span, 120::BIGINT AS capacity, (SELECT n FROM k)::BIGINT AS retained, count(*) FILTER (admitted)::BIGINT AS admitted, 0::BIGINT AS expired,
 (count(*) FILTER (admitted) - (SELECT n FROM k))::BIGINT AS evicted, count(*) FILTER (NOT admitted)::BIGINT AS repeats FROM m""",
    "stats_span_capacity": stats_capped_sql(EV, DAY, 120),
    "stats_last_span_capacity": stats_last_capped_sql(EV, DAY, 120),
    "window_resumed": _ADM1,
}
_CALL = f"CASE WHEN epoch_us(ts) <= {CALLS[0]} THEN 0 WHEN epoch_us(ts) <= {CALLS[1]} THEN 1 ELSE 2 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END"
_DELIVERED = f"""d AS (SELECT event_id, user_id, ts, c, coalesce(epoch_us(ts) < (SELECT max(epoch_us(x.ts)) FROM events x WHERE {_CALL.replace('ts', 'x.ts').replace('event_id', 'x.event_id')} < d.c), false) AS late
 FROM (SELECT *, {_CALL} AS c FROM events) d)"""
_ON_TIME = f"{_DELIVERED}, {EV.replace('FROM events', 'FROM d WHERE NOT late')}"
ORACLE |= {
    "window_late": first_sql(_ON_TIME, HOUR).replace(MARK, f"{MARK.replace(' FROM', ', false AS late FROM')} UNION ALL SELECT event_id, user_id::VARCHAR, NULL, true FROM d WHERE late"),
    "window_fresh": ORACLE["keys_snapshot"],
    "seen_asked": f"WITH {_ALL_HELD} SELECT c_custkey, c_name, c_custkey::VARCHAR IN (SELECT key FROM l WHERE (SELECT max(epoch_us(ts)) FROM events) + {DAY // 2} - anchor <= {DAY}) AS seen FROM customer",
    "seen_pruned": f"WITH {_ALL_HELD} SELECT o_orderkey, o_custkey, o_custkey::VARCHAR IN (SELECT key FROM l WHERE (SELECT max(epoch_us(ts)) FROM events) + {DAY // 2} - anchor <= {DAY}) AS seen FROM orders",
    "window_folder": f"WITH {_NOW_HELD} SELECT key, anchor, tie FROM held",
    "seen_asof": asof_sql(2 * HOUR, "anchors AS (SELECT user_id::VARCHAR AS k, epoch_us(ts) AS t FROM events)"),
    "seen_asof_first": asof_sql(2 * HOUR, first_sql(EV, 2 * HOUR).removeprefix("WITH ").replace(MARK, "").rstrip() + ", anchors AS (SELECT ev.k, ev.t FROM ev JOIN adm USING (i))"),
    "reuse_distance": distances_sql(EV, DAY, CAPACITIES),
    "sql_observe": _ADM1,
    "stream_first": f"""SELECT row_id, key, admitted, false AS late FROM ({_ADM1.replace('ev.k AS key', 'ev.t, ev.k AS key')}) m
 WHERE (t // {bucket_us(WindowConfig(HOUR))} + 1) * {bucket_us(WindowConfig(HOUR))} <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events)""",
}
ORACLE["window_resumed_stats"] = ORACLE["stats_span"]

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from keyhold.operators.scan import scan


@pytest.mark.parametrize("seed", range(3))
def test_equals_running_totals(spark, seed):
    rng = random.Random(seed)
    keys = [0] * 300 + [rng.randrange(20) for _ in range(200)]  # one key with most rows
    rows = [(k, i, rng.randrange(-50, 50)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, t long, x long")
    got = scan(df, "k", [F.asc("t")], ["x"], lambda d: d.checkpoint(), 7)
    want, n, total = {}, {}, {}
    for k, t, x in rows:
        n[k], total[k] = n.get(k, -1) + 1, total.get(k, 0) + x
        want[t] = (k, n[k], total[k])
    assert {r.t: (r.k, r.pos, r.run_x) for r in got.collect()} == want
    assert set(got.columns) == {"k", "t", "x", "pos", "run_x"}


def test_text_keys_descending_and_empty(spark):
    df = spark.createDataFrame([("b", 1, 2), ("a", 5, 1), ("b", 3, 7), ("b", 2, 1)], "k string, t long, x long")
    got = scan(df, "k", [F.desc("t")], ["x"], lambda d: d.checkpoint(), 2).collect()
    assert sorted((r.k, r.t, r.pos, r.run_x) for r in got) == [("a", 5, 0, 1), ("b", 1, 2, 10), ("b", 2, 1, 8), ("b", 3, 0, 7)]
    assert scan(df.limit(0), "k", [F.asc("t")], [], lambda d: d.checkpoint(), 2).count() == 0

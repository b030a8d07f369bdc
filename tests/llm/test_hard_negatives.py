from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyhold.llm import hard_negatives, queries, registry
from tests.oracle import same

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, anchor, low=80, high=100, most=5):
    """The definition, pair by pair, in whole numbers of any size."""
    fit = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(y is None or not math.isfinite(y) for y in x):
            continue
        q = [math.floor(256 * y) for y in x]
        if sum(y * y for y in q) < hard_negatives.NORM:
            fit.append((i, label, q))
    out = []
    for a, label, q in fit:
        if not anchor(a):
            continue
        scores = [(-sum(y * z for y, z in zip(q, x)), i, of == label) for i, of, x in fit if i != a and len(x) == len(q)]
        for ps, p, _ in sorted(s for s in scores if s[2])[:most]:
            fits = sorted(s for s in scores if not s[2] and low * -ps <= 100 * -s[0] <= high * -ps)[:most]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(fits)]
    return sorted(out)


def told(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_query_equals_sql(spark):
    assert same(queries.op12_hard_negatives(spark, "/root/testdata/sf0.01"), registry.ORACLE["op12_hard_negatives"], "/root/testdata/sf0.01") > 20


def clustered(rng, count, dims):
    centres = rng.normal(size=(8, dims))
    x = centres[rng.integers(0, 8, count)] + rng.normal(size=(count, dims)) * 0.3
    return [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed, monkeypatch):
    """Small slices and groups, so that anchors are sent to some alone; odd rows, ties, repeated rows, other lengths."""
    monkeypatch.setattr(hard_negatives, "SLICE_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "GROUPS", 5)
    rows = clustered(np.random.default_rng(seed), 400, 6)
    rows += [(1000 + i, i % 3, [1.0] * 6) for i in range(60)]  # equal vectors
    rows += [(2000 + i, i % 2, [0.5, float(i)]) for i in range(12)]  # of another length
    rows += [(3000, 1, None), (3001, None, [1.0] * 6), (3002, 1, [None] * 6), (3003, 1, [math.nan] * 6), (3004, 1, [math.inf] * 6), (None, 1, [1.0] * 6), (3005, 1, [1e300] * 6), (3006, 1, []), (3008, 2, [])]
    rows += [(3010, 0, [1e6] * 6), (3011, 1, [9e5] * 6), (3012, 0, [95e4] * 6)] + rows[:20]
    df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), SCHEMA).repartition(4).withColumns({c: F.lit(1) for c in ("row", "slice", "id", "far", "score")})
    assert told(hard_negatives.mine(df, F.col("vec_id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0)


def test_large_scores(spark):
    """Beyond what double precision holds, products are summed up in whole numbers."""
    rows = [(i, i % 2, [250_000.0 + i, 600_001.0, float(i)]) for i in range(30)]
    assert brute(rows, lambda i: i < 4) and told(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") < 4)) == brute(rows, lambda i: i < 4)


def test_empty_and_anchorless(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], SCHEMA), F.lit(None).cast("boolean")).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, None, [1.0])], SCHEMA), F.lit(True)).count() == 0


def test_brackets_hold():
    """The bracket from pivot distances holds the score, and prunes where vectors lie in clusters."""
    rng = np.random.default_rng(0)
    x = np.floor(256 * np.array([v for *_, v in clustered(rng, 500, 8)]))
    pivots = hard_negatives.Pivots(8, x[:8], float((x**2).sum(axis=1).max()))
    far = pivots.of_rows(x)
    pruned = 0
    for a in x[:50]:
        d = pivots.of_anchors(a[None])[0]
        worst, best = pivots.scores(float((a**2).sum()), np.abs(far - d).max(axis=1), (far + d).min(axis=1))
        scores = x @ a
        assert (worst <= scores).all() and (scores <= best).all()
        pruned += (best < np.sort(scores)[-20]).sum()
    assert pruned > 0.1 * 50 * 500

"""Exact and near dedup against SQL and brute force."""

from __future__ import annotations

import glob
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyhold.llm import exact_dedup, ngram_join, registry, shared
from keyhold.llm import shingles as shingle_words
from keyhold.llm.components import components
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_ngram_join", "op7_exact_dedup"])
def test_sql(spark, name):
    assert same(registry.QUERIES[name](spark, SF), registry.ORACLE[name]) == 200


ODD = [(1, "a b", 5), (2, None, 5), (3, "", 5), (4, "a b", 5), (5, "A b", 5), (None, "a b", 5), (4, "a b", 5), (6, " \t ", 5), (7, "z " * 30_000, 5), (8, "z " * 30_000, 6)]


def test_exact_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, keep_id long")
    got = [tuple(r)[:4] for r in exact_dedup.exact_dedup(df).collect()]
    want = [(1, 4, 4, False), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 4, True), (4, 4, 4, True), (5, 5, 1, True), (6, 6, 1, True), (7, 8, 2, False), (8, 8, 2, True), (None, 4, 4, False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.keep_one(df).collect()) == [3, 4, 5, 6, 8]
    again = spark.createDataFrame([(4, "a"), (4, "b"), (5, "b"), (4, "a"), (None, "c"), (None, "c"), (7, None), (7, "")], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in exact_dedup.keep_one(again).fillna("").collect()))) == ["(4, 'a')", "(5, 'b')", "(7, '')", "(None, 'c')"]
    assert exact_dedup.keep_one(df.limit(0)).count() == 0
    low = exact_dedup.exact_dedup(df, normalize=F.lower("text")).collect()
    assert {(r.doc_id, r.keep_id) for r in low if r.doc_id in (1, 5)} == {(1, 5), (5, 5)}


def test_exact_moves_a_text_once(spark):
    """What is shuffled, apart from the texts of large groups: each text once, though it is a grouping key twice."""
    text = F.concat_ws(" ", *(F.sha2(F.concat_ws(":", "id", F.lit(i)), 256) for i in range(60)))
    df = spark.range(4_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "of one group").otherwise(text).alias("text"))
    context = spark.sparkContext._jsc.sc()
    none, quantiles = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled() -> int:
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(none, False, False, quantiles, none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    got = exact_dedup.exact_dedup(df).collect()
    size = 3_000 * 60 * 65
    assert len(got) == 4_000 and {(r.keep_id, r.group_size) for r in got if r.doc_id % 4 == 0} == {(3_996, 1_000)} and sum(r.kept for r in got) == 3_001
    assert shuffled() - before < size  # hex digits take little more than half their size once packed


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    best = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    return {(i, len(sets[i]), best[i]) for i in sets}


def near_rows(seed, groups, size, words):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [f"e{rng.randrange(99)}"] * rng.randint(0, 1)
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_brute(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)  # so that signatures are compared in blocks
    rows = near_rows(seed, 25, 12, (3, 260)) + [(1000 + i, t) for i, (_, t, _) in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in ngram_join.near_components(df).collect()} == brute(rows)


def test_near_odd(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a B c"), (2, None)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in ngram_join.near_components(df).collect()))) == ["(1, 1, 1)", "(1, 1, 1)", "(2, 0, 2)", "(None, 1, None)"]
    assert ngram_join.near_components(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(4, 400), st.integers(0, 2**31), st.sampled_from([0, 1 / 4, 1]))
def test_pigeonhole(size, seed, wide):
    """Any two sets that link share a signature under the cut of the smaller one's band."""
    import numpy as np

    rng = np.random.default_rng(seed)
    k = int(np.searchsorted(ngram_join.EDGES, size, side="right")) - 1
    low, high = int(ngram_join.EDGES[k]), int(ngram_join.EDGES[k + 1])
    least = ngram_join.limit(high - 1) + 1
    skip = int(rng.integers(0, 4))
    plan = ngram_join.Band(low, high, least + 2 * skip, int(wide * (least + 2 * skip) / 2), skip)
    a = rng.integers(0, 2**64, size, dtype=np.uint64)
    d = int(rng.integers(0, ngram_join.limit(size) + 1))
    out = int(rng.integers(0, min(d, size - 1) + 1))
    b = np.concatenate((a[out:], rng.integers(0, 2**64, d - out, dtype=np.uint64)))
    both, union = size - out, size + d - out
    if len(b) < size or 100 * both < 80 * union:
        return
    at, sig = ngram_join.signatures([np.sort(a), np.sort(b)], np.array([k, k]), {k: plan})
    assert set(sig[at == 0].tolist()) & set(sig[at == 1].tolist())


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (None, 3)]
    want = {}
    for a, b in pairs:
        if a is not None and a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(200):
        for a, b in pairs:
            if a is not None and a != b:
                want[a] = want[b] = min(want[a], want[b])
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_near_leaves_no_tables_of_its_own(spark):
    """Only what the result is read from stays, and signatures go in 48 bits a number."""
    at = f"{shared.shared_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file:")
    before = set(glob.glob(f"{at}/*"))
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (3, "x y z")], "doc_id long, text string")
    assert sorted(r.component_id for r in ngram_join.near_components(df).collect()) == [1, 1, 3]
    assert {p.rsplit("/", 1)[-1].split("-")[0] for p in set(glob.glob(f"{at}/*")) - before} == {"near"}
    some = [np.array(x, dtype=np.int64) for x in ([5, 1 << 47, 7], [1, (1 << 48) - 1, 0])]
    packed = ngram_join._packed(np.array([1, 0, 1]), *some)
    assert {p: len(x) for p, x in packed.items()} == {0: 12, 1: 24}
    assert [x.tolist() for x in ngram_join._unpacked(packed[1], 2)] == [[5, 7], [1, 0]] and [x.tolist() for x in ngram_join._unpacked(packed[0], 2)] == [[1 << 47], [(1 << 48) - 1]]


def test_near_words(spark):
    """Different texts never link by their hashes: a word that a polynomial modulo 2^64 can't tell from its complement."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = word.translate({97: 98, 98: 97})
    df = spark.createDataFrame([(1, word), (2, other), (3, f"q w e {word} r t"), (4, f"q w e {other} r t")], "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in ngram_join.near_components(df).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(0, 6))
def test_link_words(x, y, cut):
    y = x[cut:] + y[:3] if cut < 5 else y
    f, g = shingles(" ".join(x)), shingles(" ".join(y))
    to = lambda w: [c.encode() for c in w]
    assert shingle_words.link(to(x), to(y), 80, 100) == bool(f and g and 100 * len(f & g) >= 80 * len(f | g))


def test_near_repeated_ids(spark):
    """Rows with one id are told apart by their texts; of each component one row stays."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (1, "quite another text of some words", "b"), (2, long + " x", "c"), (2, "a third text that is like no other one", "d"), (1, long, "e"), (3, None, "f"), (3, "", "g"), (None, long, "h"), (4, "quite another text of some words", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    kept = sorted(r.n_shingles for r in ngram_join.keep_one(df).collect())
    assert kept in (["a", "b", "d", "f", "g", "h"], ["b", "d", "e", "f", "g", "h"])
    assert ngram_join.keep_one(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in ngram_join.keep_one(df.filter("n_shingles IN ('b', 'd', 'i')")).collect()) == [1, 2]


def test_near_hot_signature(spark, monkeypatch):
    """A large family and its near misses, more members than a block and a task take."""
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    monkeypatch.setattr(ngram_join, "TOGETHER", 60)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(0, 120, 6), rng.choice([1, 2, 4, 5, 6])):
            w[at] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {tuple(r) for r in ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows) and len({c for _, _, c in got}) > 5


def meeting_words(count):
    """Pairs of different words of 16 letters and digits with one hash, made from the hash's own constants."""
    rng, good = random.Random(1), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789-.", dtype=np.uint8)
    fit = np.zeros(256, dtype=bool)
    fit[good] = True
    out = []
    while len(out) < count:
        p, q = (bytes(rng.choice(good.tolist()) for _ in range(8)) for _ in range(2))
        state = [int(shingle_words.mix((shingle_words.mix(np.array([16], dtype=np.uint64) ^ shingle_words._KEY) ^ np.frombuffer(x, "<u8")) * shingle_words._STEP + shingle_words._KEY)[0]) for x in (p, q)]
        mask = np.frombuffer((state[0] ^ state[1]).to_bytes(8, "little"), dtype=np.uint8)
        ends = [[(c, c ^ int(m)) for c in good.tolist() if fit[c ^ int(m)]] for m in mask]
        if all(ends):
            a, b = (bytes(e[0][i] for e in ends) for i in (0, 1))
            out.append(((p + a).decode(), (q + b).decode()))
    return out


def test_sets_with_one_hashed_name(spark):
    """Texts without a common word whose words have equal hashes: different sets of one name. They don't link, whatever else does."""
    pairs = meeting_words(9)
    one, two = (" ".join(p[i] for p in pairs) for i in (0, 1))
    hashed = list(shingle_words.shingle_sets([one, two]))
    assert one != two and (hashed[0] == hashed[1]).all()
    rows = [(1, one), (2, two), (3, one.upper()), (4, two), (5, two.replace(" ", "  ")), (None, one), (6, f"{one} more"), (7, "a b c"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 2, None: None, 6: 1, 7: 7, 8: 8}
    assert {(i, n, c) for i, n, c in brute([r for r in rows if r[0]])} == {(i, n, got[i]) for i, n, c in brute([r for r in rows if r[0]])}
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(df).collect()) == ["1", "2", "7", "8", "None"]
    again = spark.createDataFrame([(1, one), (1, two), (1, one), (2, two)], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.keep_one(again).collect()) == sorted([(1, one), (1, two)])

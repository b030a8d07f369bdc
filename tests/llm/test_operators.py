"""The other operators against brute force, SQL, the tokenizers library and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from keyhold.llm import bpe, embedding_dedup, html_text, language_id, line_dedup, packing, queries, rans, registry, shared, token_files, tokens, url_filter
from tests.llm.pages import page
from tests.llm.test_dedup import brute
from tests.oracle import same

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " ", " a", "a  b \n c's it's", "<|endoftext|> x", "İstanbul ΑΣ ﬁ ñ́ \u0085 q", "\n\n a\tb ", "日本語 한국어 😀!", "Æ'S  'LL", "a\x00b \x1c c", "z" * 5000, "the of and " * 9000]


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def odd(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD_TEXTS)] + [(None, "null id", None, None), (3, " a", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, n_lines long")


# 1: URL filters


@pytest.mark.parametrize("name", ["op1_url_filter", "op8_embedding_dedup"])
def test_sql(spark, name):
    assert same(registry.QUERIES[name](spark, SF), registry.ORACLE[name]) >= 50


def test_urls(spark, monkeypatch):
    rng = random.Random(5)
    hosts = ["com", "example.com", "a.example.com", "net", "xexample.com", ""]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts[:4] for p in ("", "/", "/en", "/en/7", "/en/77/x")]
    urls = [f"{s}{h}{p}" for s in ("http://", "", "x://y://") for h in ["Com", "EXAMPLE.com", "b.a.example.com", "xexample.com", ""] for p in ("", "/", "/en", "/en/", "/en/771?a", "/e#n", "?x", "/en/77/xy")] + [None]

    def judged(url):
        host, path = url_filter.parts(url)
        host = host.lower()
        fit = [(len(h.split(".")), len(p), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    df = spark.createDataFrame([(u, "clash") for u in urls], "url string, host string")
    for block in (1000, 7):
        got = [tuple(r) for r in url_filter.judge(df, rules, block=block).collect()]
        assert got == [(u, *judged(u)) for u in urls]
    assert url_filter.judge(df.limit(0), rules).count() == 0 and url_filter.judge(df, []).filter("rule IS NOT NULL").count() == 0


def test_urls_not_nested(spark):
    """The longest host decides before the longest path, in the operator as in the SQL."""
    rules = [("block", "com", "/en/very/long"), ("allow", "example.com", "/e")]
    df = spark.createDataFrame([(1, "http://example.com/en/very/long/x"), (2, "http://b.com/en/very/long")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filter.judge(df, rules).collect()] == [("example.com/e", "allow"), ("com/en/very/long", "block")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES (1, 'http://example.com/en/very/long/x'), (2, 'http://b.com/en/very/long')) t(page_id, url)")
    sql = registry.OP1.replace(", ".join(map(str, queries.RULES)), ", ".join(map(str, rules)))
    assert sorted(con.execute(f"SELECT page_id, rule, verdict FROM ({sql})").fetchall()) == [(1, "example.com/e", "allow"), (2, "com/en/very/long", "block")]


# 3: line dedup


def brute_lines(rows):
    """The definition over whole texts in memory, in id order; it shares no code with the operator."""

    def number(x):
        return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=12).digest()[:8], "little")

    def cut(full):
        out = set()
        for bit in (59, 47, 35, 23):
            first = 0
            for i in range(len(full)):
                if len(full[i].split()) > 50:
                    out |= {(first, i), (i, i + 1)}
                    first = i + 1
                elif i - first >= 1:
                    h = (number(full[i - 1]) * 0x9E3779B97F4A7C15 + number(full[i])) % 2**64
                    if not ((h ^ h >> 29) * 0x9E3779B97F4A7C15 % 2**64 >> bit) % 2:
                        out.add((first, i + 1))
                        first = i + 1
            out.add((first, len(full)))
        return sorted((lo, hi) for lo, hi in out if hi - lo > 1 or hi - lo == 1 and len(full[lo].split()) > 50)

    owner, out = {}, {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip()]
        full, gone = [lines[k] for k in at], set()
        for lo, hi in cut(full):
            content = "\n".join(lines[at[lo] : at[hi - 1] + 1])
            if content not in owner:
                owner[content] = i, full, lo, hi
                continue
            who, other, a, b = owner[content]
            if who == i and lo < b:
                continue
            x, y = lo, hi
            if who != i:
                while x > 0 and a > 0 and lo - x < 4 and full[x - 1] == other[a - 1]:
                    x, a = x - 1, a - 1
                while y < len(full) and b < len(other) and y - hi < 4 and full[y] == other[b]:
                    y, b = y + 1, b + 1
            gone.update(range(at[x], at[y - 1] + 1))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def texts_with_runs(seed, length, texts=60, every=3, line_words=9):
    """Texts of lines of their own; every third holds a run of ``length`` lines, somewhere."""
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(10**5)) for _ in range(line_words))
    run, rows, own = [line() for _ in range(length)], [], {}
    for i in range(texts):
        lines = [line() for _ in range(rng.randint(0, 12))]
        if i % 5 == 0:
            lines.insert(0, "")
        own[i] = "\n".join(lines)
        if i % every == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = run
        rows.append((i, "\n".join(lines)))
    return run, rows, own


def test_lines(spark):
    run, rows, _ = texts_with_runs(8, 12)
    rows += [(99, rows[4][1]), (98, ""), (97, "\n\n \n"), (96, "\n\n \n"), (95, rows[9][1] + "\n" + rows[9][1])]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(rows)
    assert all(r.n_removed == sum(s.end - s.first for s in r.spans) for r in got)
    assert sum("\n".join(run) in r.text for r in got) == 1
    assert all(r.n_lines == t.count("\n") + 1 for r, t in zip(sorted(got, key=lambda r: r.doc_id), [t for _, t in sorted(rows)]))


def test_lines_recall():
    """The share of a repeated run's copies that go whole, by the run's lines; what is of its own always stays."""
    found = {}
    for length in (2, 3, 4, 6, 8, 12):
        whole = copies = 0
        for seed in range(30):
            run, rows, own = texts_with_runs(1000 * length + seed, length, texts=9)
            out = brute_lines(rows)
            for i, _ in rows[1:]:
                if i % 3 == 0:
                    copies += 1
                    whole += out[i] == own[i]
                else:
                    assert out[i] == own[i]
        found[length] = whole / copies
    print("recall by lines of a run", {k: round(v, 2) for k, v in found.items()})
    assert found[4] > 0.75 and found[6] > 0.95 and found[8] > 0.98


def test_lines_odd(spark):
    got = line_dedup.dedup_lines(odd(spark))
    assert got.columns == ["doc_id", "text", "start", "n_lines", "n_removed", "spans"] and got.count() == len(ODD_TEXTS) + 2
    assert sorted(r.text or "" for r in got.collect()) == sorted([t or "" for t in ODD_TEXTS] + ["null id", " a"])
    assert line_dedup.dedup_lines(odd(spark).limit(0)).count() == 0


def test_lines_ids(spark):
    """Rows with one id, or without any, are rows of their own: of a passage in all of them one copy stays."""
    passage = "one line of some words " * 12 + "\nand another line of them"
    rows = [(None, f"{passage}\nx{i} y") for i in range(6)] + [(5, f"z{i} q\n{passage}") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.dedup_lines(df).collect()
    assert sorted(r.n_removed for r in got) == [0] + [2] * 9 and next(r for r in got if not r.n_removed).doc_id == 5
    none = line_dedup.dedup_lines(df.filter("doc_id IS NULL")).collect()
    assert sorted(r.n_removed for r in none) == [0] + [2] * 5


@pytest.mark.parametrize("n", [1, 2, 5])
def test_passages(spark, n):
    """A passage of over 50 words goes whole from all documents but the first, whatever stands around it."""
    rng = random.Random(n)
    line = lambda k=9: " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(10**6)) for _ in range(k))
    passage = [line(51), *(line() for _ in range(n - 1))]
    if n == 5:
        passage.insert(2, "")
    rows, want = [], []
    for i in range(24):
        before, after = ([line() for _ in range(rng.randint(0, 6))] for _ in range(2))
        before = ["A short line", "", line(), *before]
        rows.append((i, "\n".join([*before, *passage, *after])))
        want.append("\n".join([*before, *(passage if i == 0 else []), *after]))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.doc_id)] == want
    assert all(r.n_removed == sum(s.end - s.first for s in r.spans) for r in got)


# 4: packing


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.dictionaries(st.integers(1, 60), st.integers(1, 5), max_size=7))
def test_fill(room, counts):
    """The subset sum is the best there is, and uses no more pieces than there are."""
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * m for s in sums for m in range(n + 1)}
    got = packing.fill(room, sorted(counts.items(), reverse=True))
    assert sum(k * n for k, n in got) == max(s for s in sums if s <= room) and all(n <= counts[k] for k, n in got)


def test_packing(spark):
    df = odd(spark)
    library = Tokenizer.from_file(queries.WORD_TOKENIZER)
    pieces = packing.pack_documents(df, queries.WORD_TOKENIZER, 2, 64).collect()
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    assert sorted(windows) == list(range(len(windows)))
    for w in windows.values():
        w.sort(key=lambda p: p.offset)
        assert [p.offset for p in w] == [sum(x.length for x in w[:i]) for i in range(len(w))] and sum(p.length for p in w) <= 64
    for i, t in enumerate(ODD_TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted({(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces if p.doc_id == i})
        raw = np.array(ids, dtype="<u4")
        assert own == [(s, len(raw[s : s + 64]), zlib.crc32(raw[s : s + 64].tobytes()), len(ids)) for s in range(0, len(ids), 64)]
    assert packing.pack_documents(df.limit(0), queries.WORD_TOKENIZER, 2).count() == 0
    ids = packing.cut(df, lambda: tokens.encoder(queries.WORD_TOKENIZER), 2, 64)
    full = packing.windows(packing.pack(ids, 64), 0, 64).collect()
    assert len(full) == len(windows) and all(len(w.ids) == 64 or len(w.ids) & len(w.ids) - 1 == 0 for w in full)


# 5: language ID


def brute_top(texts):
    from collections import Counter

    c = Counter()
    for t in texts:
        letters = "".join(x if x.isalpha() else " " for x in t.lower())
        for w in letters.split():
            p = f" {w} "
            c.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n] != " ")
    code = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))][: language_id.RANKS]


def brute_profiles(train):
    return {lang: {g: i for i, g in enumerate(brute_top([t for t, x in train if x == lang]))} for lang in {g for _, g in train}}


def brute_language(profiles, text):
    own = brute_top([text or ""])
    away = [(sum(abs(rank[g] - i) if g in rank else language_id.RANKS for i, g in enumerate(own)), lang) for lang, rank in profiles.items()]
    return min(away)[1] if own else "und"


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_language_id(spark, SF).collect()}
    rows = docs.collect()
    train = [(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    rank = brute_profiles(train)
    assert all(got[r.doc_id].lang_pred == brute_language(rank, r.text) for r in rows)
    held = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert sum(held) >= 0.95 * len(held)


def test_language_odd(spark):
    df = odd(spark)
    profiles = language_id.train(df.selectExpr("text", "if(text like '%a%', 'a', null) AS lang"))
    got = language_id.identify(df, profiles).collect()
    assert len(got) == len(ODD_TEXTS) + 2 and {r.lang_pred for r in got if r.text in (None, "", " ")} == {"und"} and all(0 <= r.score <= 1 for r in got)
    none = language_id.train(df.selectExpr("text", "cast(null AS string) AS lang"))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(df.limit(0), profiles).count() == 0


def test_language_letters(spark):
    """Numbers and signs that a regex takes for word characters are no letters; letters beyond the profiles are."""
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["the of and", "½ ② ³ Ⅷ ௰ 12 _", "𝟘 ٣", "ℵ", "日本"])], "doc_id long, text string, lang string")
    profiles = language_id.train(df.filter("doc_id = 0"))
    got = [(r.lang_pred, r.score > 0) for r in sorted(language_id.identify(df, profiles).collect(), key=lambda r: r.doc_id)]
    assert got == [("en", True), ("und", False), ("und", False), ("en", False), ("en", False)]


def test_keep_known(spark):
    """Texts of a language without a profile go, and so do those without letters; clashing columns stay."""
    words = {"en": "the of and to in that is was for with", "fr": "le la de et que les des une pour dans"}
    rows = [(i, " ".join(random.Random(i).choices(words[lang].split(), k=30)), lang, 0.5, None) for i in range(40) for lang in [("en", "fr")[i % 2]]]
    rows += [(100, "это совсем другой язык и буквы другие", None, 0.1, 7), (101, "123 !!", None, 0.1, 7), (102, None, "en", None, None), (None, "the of and", None, 0.2, 1), (1, rows[1][1], "fr", 0.5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, _score int")
    got = language_id.keep_known(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in rows if r[0] not in (100, 101, 102))
    assert language_id.keep_known(df.limit(0)).count() == 0


def test_count_in_small_steps():
    """What a task holds while it counts n-grams: some thousand words at a time; the counts are those of all words at once."""
    import tracemalloc

    words = ["abcdefgh"[i % 7 :] + "xyz"[: i % 3] for i in range(99_000)]
    want = dict(zip(*(x.tolist() for x in np.unique(language_id.grams(words), return_counts=True))))
    tracemalloc.start()
    codes, counts = language_id.counted(words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(codes.tolist(), counts.tolist())) == want
    assert most < 24 << 20


# 6: BPE


@pytest.mark.parametrize("path", [queries.WORD_TOKENIZER, queries.BYTE_TOKENIZER])
def test_bpe_library(documents, path):
    library, own, fast = Tokenizer.from_file(path), bpe.codec(path), tokens.encoder(path)
    library.no_truncation(), library.no_padding()
    for t in ODD_TEXTS + [t for _, t in documents[:60]]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids == fast(t).tolist(), t
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        machine = bpe.Decoder(own)
        assert "".join([machine.feed(i) for i in ids[:500]]) + machine.end() == library.decode(ids[:500], skip_special_tokens=False)


def test_held_bytes():
    """What is remembered stays below a number of bytes, however long the words are."""
    held = tokens.Held(lambda ws: [w.encode() for w in ws], most=10**6, most_bytes=10_000)
    for i in range(300):
        words = [f"{i}-{k}" + "x" * (3 * i) for k in range(5)]
        assert held.all(words) == [w.encode() for w in words]
        assert sum(len(w) + len(v) for d in (held.young, held.old) for w, v in d.items()) <= 4 * 10_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("abcd")), max_size=9), st.text("abcd", min_size=1, max_size=60), st.data())
def test_transducer(first, word, data):
    """Any merge list, merged in the plain way, gives what the transducer streams."""
    merges, made = [], list("abcd")
    for _ in first:
        pair = data.draw(st.tuples(st.sampled_from(made), st.sampled_from(made)))
        if pair not in merges:
            merges.append(pair)
            made.append(pair[0] + pair[1])
    t = bpe.Transducer({m: i for i, m in enumerate(dict.fromkeys(made))}, merges)
    assert list(t.tokens(word)) == t.merged(list(word))


def test_transducer_tries_only_tokens():
    """At each place the tokens that end there are tried and no other strings; what is remembered is bounded."""
    t = bpe.codec(queries.WORD_TOKENIZER).transducer
    at, word = "", "internationalisations"
    for i, c in enumerate(word, 1):
        at, inside, at_end = t.step(at + c)
        ends = [word[k:i] for k in range(i)]
        assert [x for _, x in inside] == [x for x in ends if t.own(x)]
        assert [x for _, x in at_end] == [x + t.suffix for x in ends if t.own(x + t.suffix)]
    small = bpe.Transducer({x: i for i, x in enumerate(["a", "b", "ab"])}, [("a", "b")])
    for i in range(300_000):
        small.step(chr(0x10000 + i))
    assert len(small._steps) <= bpe.HELD_STEPS + 1 and list(small.tokens("abba")) == ["ab", "b", "a"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab'sRé0.- \n\tßЖ", max_size=30), max_size=6))
def test_joined_words(texts):
    """Words that are encoded in one text come out as by themselves, in the transducer as in the library."""
    for path in (queries.WORD_TOKENIZER, queries.BYTE_TOKENIZER):
        fast, own = tokens.Encoder.__new__(tokens.Encoder), bpe.codec(path)
        fast.__dict__.update(tokens.encoder(path).__dict__)
        fast.words, fast.runs = tokens.Known(fast._of_words, 5), tokens.Known(fast._of_runs, 5)  # forget soon
        for t in texts:
            ids = fast.library.encode(t, add_special_tokens=False).ids
            assert fast(t).tolist() == ids == own.encode(t).tolist(), t


def test_bpe_rows(spark):
    library = Tokenizer.from_file(queries.WORD_TOKENIZER)
    for r in bpe.round_trip(odd(spark).filter("doc_id <> 3"), queries.WORD_TOKENIZER).collect():
        ids = library.encode(ODD_TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(odd(spark), queries.BYTE_TOKENIZER), queries.BYTE_TOKENIZER).filter("doc_id = 8").first()
    assert back.text == ODD_TEXTS[8]
    assert bpe.round_trip(odd(spark).limit(0), queries.WORD_TOKENIZER).count() == 0


# 8: vectors


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 5)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(30):
        centre = rng.standard_normal(24)
        rows += [(len(rows) + k, (centre + 0.28 * rng.standard_normal(24)).tolist(), 1) for k in range(rng.integers(1, 14))]
    rows += [(1000 + i, rows[3][1], 2) for i in range(7)]
    odd_rows = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, []), (2005, [1.0]), (2006, [2.0]), (None, rows[3][1]), (3, rows[3][1])]
    rows += [(i, v, 3) for i, v in odd_rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long").repartition(3)
    good = [(i, np.array(v, dtype=float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    link = [[len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95 for _, y in good] for _, x in good]
    least = [i for i, _ in good]
    for _ in good:
        least = [min(b for b, ok in zip(least, row) if ok) for row in link]
    want = sorted([(i, sum(row) - 1, c, i == c) for (i, _), row, c in zip(good, link, least)] + [(i, 0, i, True) for i in range(2000, 2005)] + [(None, 0, None, None)], key=str)
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(df).collect()), key=str)
    assert got == want and any(1 < n for _, n, _, _ in want)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def clustered(seed, size, pairs, dim=64, mutual=0.88, cosine=0.955):
    """Vectors around one centre, and others close to the first of them: pairs (i, size + i)."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.standard_normal(dim))
    x = unit(np.sqrt(mutual) * centre + np.sqrt(1 - mutual) * unit(rng.standard_normal((size, dim))))
    noise = rng.standard_normal((pairs, dim))
    noise = unit(noise - (noise * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    return np.concatenate((x, cosine * x[:pairs] + np.sqrt(1 - cosine**2) * noise))


def test_vectors_clustered(spark, monkeypatch):
    """Pairs in a crowd of like vectors are met as well."""
    monkeypatch.setattr(embedding_dedup, "CROWD_BLOCK", 700)
    x = np.concatenate((clustered(3, 3000, 300), np.random.default_rng(9).standard_normal((3000, 64))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_vectors(df).collect()}
    assert sum(got[i] == got[3000 + i] for i in range(300)) >= 297


def test_vectors_common_mean(spark):
    """Vectors with a large common part, as trained ones have: links found against brute force."""
    size, pairs, rng = 5_000, 500, np.random.default_rng(21)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = clustered(8, size - pairs, 0, mutual=0.86)
    noise = rng.standard_normal((pairs, 64))
    noise = unit(noise - (noise * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    cosine = rng.uniform(0.951, 0.96, (pairs, 1))
    x = np.concatenate((x, cosine * x[:pairs] + np.sqrt(1 - cosine**2) * noise))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    links = [(i + k, int(j)) for i in range(0, size, 2_000) for k, j in zip(*np.nonzero(x[i : i + 2_000] @ x.T >= 0.95)) if j > i + k]
    found = sum(got[a][1] == got[b][1] for a, b in links)
    counts = np.bincount(np.array(links).ravel(), minlength=size)
    print(f"{len(links)} links, {found} within a component")
    assert len(links) >= pairs and found >= 0.99 * len(links)
    assert sum(got[i][0] == counts[i] for i in range(size)) >= size - 4 * (len(links) - found)


def test_windows_recall():
    """Recall of the windows alone, by position in the sorted passes, where vectors share a large mean."""
    rng, size, pairs = np.random.default_rng(2), 6_000, 300
    x = clustered(5, size, pairs, mutual=0.86, cosine=0.952)
    x = x[rng.permutation(len(x))]
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))]
    off = embedding_dedup.common(x[:4096])
    number = embedding_dedup.passes(len(x), off.cosine(0.95))
    met, largest = np.zeros(len(links), dtype=bool), 0
    for p in range(number):
        k = np.array([int.from_bytes(b, "big") for b in embedding_dedup.keys(x, p, off)], dtype=np.uint64)
        at = np.empty(len(x), dtype=int)
        at[np.argsort(k, kind="stable")] = np.arange(len(x))
        met |= np.array([abs(at[i] - at[j]) <= embedding_dedup.NEIGHBOURS for i, j in links])
        largest = max(largest, np.unique(k >> np.uint64(64 - embedding_dedup.prefix_bits(len(x))), return_counts=True)[1].max())
    print(f"{number} passes, {met.sum()} of {len(links)} links")
    assert met.mean() >= 0.99 and largest <= embedding_dedup.CROWD * embedding_dedup.NEIGHBOURS


# 9: pages

PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="wide-menu"><header><h1>Site</h1></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies and much text of that kind, really a lot of it, so that it is long.</div>
<article><header><h1>The  title</h1></header><p>First &amp; <b>bold</b>\n text&nbsp;here.<p>Con.<ul><li>item one<li>item two</ul><script>var t="</p>";</script>
<div class="ad">Buy now</div><form>Name <input></form><section class="comments"><p>I think that this is wrong, and I say so here.</p></section></article>
<aside>More</aside><footer>&copy; me and a long, long line that looks like text but isn't any.</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == "The title\n\nFirst & bold text here.\n\nCon.\n\nitem one\n\nitem two"
    plain = '<body><div id="menu"><a>x</a><a>y</a></div><div><h2>Head</h2><p>' + "long text " * 20 + "</p><p>Short.</p><p>" + "more text " * 20 + "</p></div><div><a>1</a></div></body>"
    assert html_text.main_text(plain).split("\n\n")[0::2] == ["Head", "Short."]
    assert html_text.main_text("<nav>a<article><p>Unclosed menu before this.</article>") == "Unclosed menu before this."
    assert [html_text.main_text(t) for t in (None, "", "<p></p>", "<script>x")] == [""] * 4
    assert html_text.main_text("just text") == "just text"


def test_page_short_lines():
    """Short lines that open or close the content stay on pages without article or main."""
    long, nav = [f"<p>{'long text ' * 20}{i}</p>" for i in range(5)], "<div><a>Home</a><p><a>News</a><p><a>Shop</a></div>"
    want = [f"{'long text ' * 20}{i}" for i in range(5)]
    items = [f"item {i} abc" for i in range(6)]
    ul = "<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>"
    foot = "<div><a>About</a><p><a>Terms</a><p><a>Help</a></div>"
    got = lambda x: html_text.main_text(f"<body>{x}</body>").split("\n\n")
    assert got(f"{nav}<div>{''.join(long)}{ul}</div>{foot}") == want + items
    assert got(f"{nav}<div>{ul}{''.join(long)}</div>{foot}") == items + want
    table = "<table>" + "".join(f"<tr><td>{i}</td></tr>" for i in items) + "</table>"
    assert got(f"{nav}<div>{''.join(long)}{table}</div>{foot}") == want + items
    assert got(f"{nav}<div>{long[0]}{long[1]}</div><div>{ul}</div><div>{long[2]}{long[3]}{long[4]}</div>{foot}") == want[:2] + items + want[2:]
    assert got(f"{nav}<div><div>{''.join(long)}</div><div>{ul}</div></div>{foot}") == want + items
    assert got(f"<ul><li><a>Home</a><li><a>News</a></ul>{''.join(long)}{ul}<p><a>Terms</a>") == want + items


def test_page_names():
    """Names in class and id weigh, but take nothing away by themselves."""
    long = "long text " * 30
    got = lambda x: html_text.main_text(f"<body>{x}</body>").split("\n\n")
    assert got(f"<main class='has-banner'><p>{long}</p><p>Short.</p></main>") == [long.strip(), "Short."]
    assert got(f"<article><p>{long}</p><div class='share-story'><p>A line.</p></div></article>") == [long.strip(), "A line."]
    assert got(f"<article><p>{long}</p><table><tr><td>Soup<td class='menu-price'>9.50</table></article>") == [long.strip(), "Soup", "9.50"]
    assert got(f"<div class='widget'><p>{long}</p><p>Short.</p></div>") == [long.strip(), "Short."]
    assert got(f"<article><p>{long}</p><div class='ad'>Buy this now</div></article>") == [long.strip()]


def test_pages_known():
    """Words of the main text found and taken, over pages that mostly have neither article nor main."""
    from collections import Counter

    hit = found = wanted = changed = 0
    for seed in range(400):
        html, blocks = page(seed)
        got, want = (Counter(" ".join(x).split()) for x in ([html_text.main_text(html)], blocks))
        hit, found, wanted = hit + (got & want).total(), found + got.total(), wanted + want.total()
        parser = html_text.Lines()
        parser.feed(html)
        lines = parser.finish()
        structure = [x.text for x in lines if x.weight == 1 and (x.article or not any(y.article for y in lines))]
        changed += structure != html_text.main_text(html).split("\n\n")
    precision, recall = hit / found, hit / wanted
    print(f"precision {precision:.4f}, recall {recall:.4f}, pages that ratios change {changed / 400:.2f}")
    assert precision >= 0.98 and recall >= 0.98 and changed >= 100


def test_pages(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (None, None, None, None), (2, "v", "<p>" + "word " * 60_000, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.n_chars for r in got] == [len(html_text.main_text(r[2])) for r in rows] and got[2].text == "" and got[3].n_chars == 299_999
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_article_beside_long_boilerplate():
    """A short article wins over long text outside; a long advert in one goes, and a region that holds all of it stays."""
    long, advert = "What the site is for, and who writes it, and how to get in touch. " * 8, "Buy this thing now, it is really cheap today and only here. " * 8
    text = html_text.main_text
    assert text(f"<body><div>{long}</div><article><p>Short.</p></article></body>") == "Short."
    assert "Buy" not in text(f"<body><article><h1>T</h1><p>{long}{long}</p><div class='advert'>{advert}</div><p>More of it.</p></article></body>")
    assert text(f"<body><article><div class='widget'><p>{long}</p></div></article></body>") == long.strip()
    teasers = "".join(f"<article><a href='/{i}'>Teaser {i}</a></article>" for i in range(4))
    assert text(f"<body><div>{teasers}</div><div><p>{long}</p><p>{long}</p></div></body>") == f"{long.strip()}\n\n{long.strip()}"


# 10: token files


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=900), st.integers(0, 3))
def test_rans(ids, often):
    ids = np.array(ids + [3] * (often * 40_000), dtype=np.int64)
    coder = rans.Coder(rans.table(np.bincount(ids, minlength=9)))
    cut = [ids[i : i + rans.BLOCK] for i in range(0, len(ids), rans.BLOCK)]
    blocks = coder.encode(cut)
    assert all(map(np.array_equal, coder.decode(blocks), cut))
    for b in blocks:
        with pytest.raises(ValueError):
            coder.decode([b[:-9] + bytes([b[-9] ^ 1]) + b[-8:]])


def test_crc_join():
    a, b = b"some bytes", b"others" * 999
    assert rans.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b) and rans.crc32_joined(5, 0, 0) == 5


def test_token_files(spark, tmp_path):
    df = odd(spark).filter("doc_id IS NULL OR doc_id <> 3")
    files = token_files.write_tokens(df, str(tmp_path / "tokens"), queries.BYTE_TOKENIZER, 0)
    library, start = Tokenizer.from_file(queries.BYTE_TOKENIZER), 0
    got = {r.doc_id: tuple(r)[1:] for r in token_files.summary(spark, files).collect()}
    for i, t in [(None, "null id"), *((i, t) for i, t in enumerate(ODD_TEXTS) if i != 3)]:
        raw = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert got[i] == (start, len(raw), zlib.crc32(raw.tobytes()))
        start += len(raw)
    assert token_files.round_trip(df.limit(0), queries.BYTE_TOKENIZER, 0).count() == 0


def test_token_files_blocks(spark, tmp_path, documents):
    """Documents over several blocks, repeated and null ids, and more than one shard."""
    rows = [(i, t) for i, t in documents[:40]] + [(7, "the of and a " * 70_000), (None, "b " * 150_000), (None, None), (7, "x"), (7, "x"), (-3, "")]
    files = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "t"), queries.BYTE_TOKENIZER, 0)
    library = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), r[1] or ""))
    want, start, every = [], 0, []
    for i, t in order:
        raw = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((i, start, len(raw), zlib.crc32(raw.tobytes())))
        start += len(raw)
        every.append(raw)
    assert sorted(map(tuple, token_files.summary(spark, files).collect()), key=lambda r: r[1]) == want
    shards = {r.shard: r.before for r in files.shards(spark).collect()}
    pieces = sorted((shards[r.shard] + r.start, r.part, r.ids) for r in token_files.decoded(spark, files).collect())
    assert b"".join(p[2] for p in pieces) == np.concatenate(every).tobytes() and len(shards) > 1
    assert max(r.part for r in token_files.decoded(spark, files).collect()) >= 2


# shared tables


def test_scratch(spark):
    from pathlib import Path

    root = Path(spark.conf.get("spark.checkpoint.dir")) / spark.sparkContext.applicationId
    before = set(root.glob("*")) if root.exists() else set()
    with shared.Scratch(spark) as outer:
        with shared.Scratch(spark) as inner:
            one, two = (shared.written(spark.range(9).repartition(2, "id"), n) for n in ("one", "two"))
            inner.drop(one)
            kept = inner.keep(two.filter("id > 3"), "kept")
        assert kept.count() == 5 and len(set(root.glob("*")) - before) == 1
        with pytest.raises(ZeroDivisionError), shared.Scratch(spark):
            shared.written(spark.range(1), "three")
            1 / 0
        last = outer.keep(kept, "last")
    assert last.count() == 5 and [p.name[:4] for p in set(root.glob("*")) - before] == ["last"]


def test_unset_folder(tmp_path):
    """Without spark.checkpoint.dir, one machine takes a folder of its own; a cluster says what is missing."""
    import os
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession
from keyhold.llm import exact_dedup, shared
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print(exact_dedup.exact_dedup(s.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")).filter("kept").count())
class Context:
    master, applicationId = "spark://somewhere", "x"
    def getConf(self): return s.sparkContext.getConf()
    def getCheckpointDir(self): return None
class Session:
    conf, sparkContext = s.conf, Context()
try:
    shared.shared_dir(Session())
except RuntimeError as e:
    print("spark.checkpoint.dir" in str(e))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)})
    assert out.stdout.split() == ["1", "True"], out.stderr[-2000:]


# the pipeline


def test_pipeline(spark, documents):
    kept = {}
    for i, t in documents:
        if any(c.isalpha() for c in t or ""):
            kept[t] = max(i, kept.get(t, i))
    near = brute([(i, t) for t, i in kept.items()])
    want = {i for i, _, c in near if i == c}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want
    assert all(sum(r.length for r in got if r.doc_id == i) == next(r.doc_tokens for r in got if r.doc_id == i) for i in list(want)[:20])

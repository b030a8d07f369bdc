"""Run a query's SQL in DuckDB and compare it with Spark's rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def sql_rows(sql: str, sf_dir: str = SF) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def same(df, sql: str, sf_dir: str = SF) -> int:
    names, want = sql_rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    clean = lambda x: round(x, 6) if isinstance(x, float) and math.isfinite(x) else x
    got = sorted((tuple(clean(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(clean(r[names.index(c)]) for c in order) for r in want), key=repr)
    assert got == want
    return len(got)

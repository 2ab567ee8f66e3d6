"""Comparison of a Spark result with DuckDB's, as multisets of rows with columns by name."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def bag(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(df, sql: str, sf_dir: str = SF) -> None:
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    want = bag(names, found.fetchall())
    got = bag(df.columns, df.collect())
    assert got[0] == want[0]
    extra, missing = got[1] - want[1], want[1] - got[1]
    assert not extra and not missing, (list(extra)[:3], list(missing)[:3], sum(extra.values()), sum(missing.values()))

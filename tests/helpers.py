"""Comparison of a DataFrame with DuckDB over the same parquet tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    r = c.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    try:
        return float(v) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def same(df, sf_dir: str, sql: str) -> None:
    names, rows = oracle(sf_dir, sql)
    columns = sorted(df.columns)
    assert columns == sorted(names)
    at = [names.index(c) for c in columns]
    want = sorted((repr([plain(r[i]) for i in at]) for r in rows))
    have = sorted((repr([plain(r[c]) for c in columns]) for r in df.collect()))
    assert have == want

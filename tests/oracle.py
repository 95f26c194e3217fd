"""Order-free comparison of a query with its DuckDB oracle."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, dict):
        return repr(sorted((plain(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return repr(v)


def of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(r[c].asDict() if hasattr(r[c], "asDict") else r[c]) for c in cols) for r in df.collect())


def of_duckdb(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())

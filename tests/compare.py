"""Runs a query and its DuckDB text over the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.isdir(path) and not glob.glob(f"{path}/*.parquet"):
            continue
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def check(spark, query, sql: str, folder: str) -> int:
    c = views(folder).execute(sql)
    names = [d[0] for d in c.description]
    df = query(spark, folder)
    assert sorted(df.columns) == sorted(names)
    want, got = rows(names, c.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert got == want
    return len(got)

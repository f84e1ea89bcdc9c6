"""Holds a query's rows against DuckDB's."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(df, con, sql):
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*sorted(df.columns)).collect())
    r = con.sql(sql)
    order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    want = sorted(repr(tuple(plain(row[i]) for i in order)) for row in r.fetchall())
    assert sorted(df.columns) == sorted(r.columns)
    assert got == want
    return len(want)

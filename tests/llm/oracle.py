"""Runs a query's SQL in DuckDB over a folder of tables and compares the rows."""

import glob
import os

import duckdb


def duck(sf_dir, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return [dict(zip(names, r, strict=True)) for r in out.fetchall()]


def same_rows(frame, sf_dir, sql):
    want = duck(sf_dir, sql)
    got = [r.asDict() for r in frame.collect()]
    order = lambda rows: sorted((tuple(sorted((k, repr(v)) for k, v in r.items())) for r in rows))
    assert order(got) == order(want)
    assert got or not want

"""Runs a query's SQL in DuckDB over a folder of tables."""

import glob
import os

import duckdb


def duck(sf_dir, sql):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS FROM '{f}'")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def sorted_rows(names, rows):
    """Rows with columns in order of their names, sorted; floats to six digits."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return [names[k] for k in order], sorted((tuple(tidy(r[k]) for k in order) for r in rows), key=repr)

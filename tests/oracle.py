"""Compares a query with its SQL in DuckDB, rows in any order."""

import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def same(df, con, sql):
    columns = sorted(df.columns)
    mine = sorted(tuple(map(repr, (r[c] for c in columns))) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    other = sorted(tuple(map(repr, (r[names.index(c)] for c in columns))) for r in found.fetchall())
    assert mine == other

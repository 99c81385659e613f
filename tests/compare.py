"""Rows of a Spark query against rows of its SQL in DuckDB."""

import glob
import os
from collections import Counter

import duckdb


def connect(folder: str):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        src = p if os.path.isfile(p) else f"{p}/*.parquet"
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{src}'")
    return c


def _plain(v):
    return None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    mine, theirs = bag(df.columns, df.collect()), bag(relation.columns, relation.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])

"""Comparison of a Spark query with its DuckDB oracle by column names and values."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _text(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    return None if v is None else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([_text(r[i]) for i in order]) for r in data)


def check(spark, con, query, sql, sf):
    df = query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    c = con.execute(sql)
    names = [d[0] for d in c.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, c.fetchall())
    assert got

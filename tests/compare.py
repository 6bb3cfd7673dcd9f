"""Rows of a query against DuckDB's for the same tables."""

import datetime as dt
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, bool | str):
        return x
    if isinstance(x, int | float | decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, dt.date | dt.datetime):
        return x.isoformat()
    if isinstance(x, list | tuple):
        return [plain(y) for y in x]
    return x


def same(spark, query, sql, sf):
    df = query(spark, sf)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = db.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    order = lambda rows, columns: sorted(repr([plain(r[columns.index(n)]) for n in names]) for r in rows)
    assert order([tuple(r) for r in df.collect()], df.columns) == order(want.fetchall(), want.columns)

"""Compare a Spark result with DuckDB's, as unordered rows."""

import datetime
import decimal
import math
import os

import duckdb


def connection(folder):
    c = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        path = path if os.path.isfile(path) else f"{path}/*.parquet"
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "null" if math.isnan(v) else f"{round(float(v), 6) + 0.0:.6f}"
    if isinstance(v, bool) or v is None:
        return str(v).lower() if v is not None else "null"
    if isinstance(v, int):
        return f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(df, sql, folder):
    found = connection(folder).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())

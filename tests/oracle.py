"""Run a query's SQL in DuckDB over the same Parquet tables, and compare rows whatever their order."""

import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def rows_of_sql(con, sql):
    found = con.sql(sql)
    columns, at = sorted(found.columns), {c: i for i, c in enumerate(found.columns)}
    return columns, sorted(repr(tuple(plain(r[at[c]]) for c in columns)) for r in found.fetchall())

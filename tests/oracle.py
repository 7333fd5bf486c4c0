"""Compares a query's rows with those of its SQL in DuckDB: columns by name, rows as a bag, doubles to 9 digits."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    got, want = bag(df.columns, df.collect()), bag(names, rel.fetchall())
    assert got == want, f"{sum(got.values())} rows, {sum(want.values())} expected; only here {list((got - want).items())[:3]}, only in SQL {list((want - got).items())[:3]}"

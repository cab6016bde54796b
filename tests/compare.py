"""Compares a query's result with that of its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def rows(names: list[str], table: list[dict]) -> list[tuple]:
    return sorted((tuple(plain(r[n]) for n in sorted(names)) for r in table), key=repr)


def same(df, sql: str, d: str) -> None:
    found = connect(d).execute(sql).to_arrow_table()
    assert sorted(df.columns) == sorted(found.column_names)
    got, want = rows(df.columns, [r.asDict() for r in df.collect()]), rows(found.column_names, found.to_pylist())
    assert len(got) == len(want)
    assert got == want

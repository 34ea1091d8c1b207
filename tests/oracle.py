"""Runs a query's SQL in DuckDB over a directory of Parquet tables and compares rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(base: str):
    con = duckdb.connect()
    for path in Path(base).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of_sql(con, sql: str, columns: list[str]) -> list:
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(columns)
    at = [rel.columns.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def rows_of_frame(df, columns: list[str]) -> list:
    return sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)

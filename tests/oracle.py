"""Row-for-row comparison of a query with its DuckDB statement."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def rows(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def oracle_rows(con, sql: str) -> list[tuple]:
    r = con.sql(sql)
    at = [r.columns.index(c) for c in sorted(r.columns)]
    return sorted((tuple(_plain(x[i]) for i in at) for x in r.fetchall()), key=repr)

"""Holds a registered query against its SQL in DuckDB over the same tables."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb

from quillcheck.tables import TABLES

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, (float, Decimal)):
        return f"{float(value) + 0.0:.9g}"
    return [plain(x) for x in value] if isinstance(value, list) else value


def connection():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)

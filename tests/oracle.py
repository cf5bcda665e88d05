"""Runs a query and its SQL twin over the same tables and compares their rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal):
        return str(v)
    return str(v)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None if both agree, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows_of(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(wrong)} of {len(got)} rows differ, as {wrong[:3]}" if wrong else None

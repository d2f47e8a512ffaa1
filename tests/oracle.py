"""Compares a query with its SQL, both as sorted rows of plain values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr), [columns[i] for i in order]


def same(df, sql: str, con) -> str | None:
    """None if both give the same rows, else what differs."""
    a, a_cols = rows(df.columns, df.collect())
    got = con.execute(sql)
    b, b_cols = rows([c[0] for c in got.description], got.fetchall())
    if a_cols != b_cols:
        return f"columns {a_cols} and {b_cols}"
    if a != b:
        odd = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{len(a)} and {len(b)} rows; first difference {odd}"
    return None

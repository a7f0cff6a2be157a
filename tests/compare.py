"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import os

import duckdb

from siltmark.session import TABLES


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


def differences(df, sql: str, c: duckdb.DuckDBPyConnection) -> str:
    """Empty if both give the same rows."""
    got = rows_of(df.columns, df.collect())
    cursor = c.execute(sql)
    want = rows_of([x[0] for x in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        return f"{len(got[1])} and {len(want[1])} rows; only ours {sorted(a)[:3]}; only SQL's {sorted(b)[:3]}"
    return ""

"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    """A value as something that compares alike from either engine."""
    if v is None:
        return None
    if isinstance(v, bool | str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return float(f"{v:.9g}") if abs(v) < 2**53 else v
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(columns: list[str], data) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(found, key=repr)


def of_spark(df) -> tuple[list[str], list]:
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_sql(con, sql: str) -> tuple[list[str], list]:
    cur = con.execute(sql)
    return rows([d[0] for d in cur.description], cur.fetchall())


def difference(a: tuple[list[str], list], b: tuple[list[str], list]) -> str:
    """Empty if equal; else what differs first."""
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows; {[x for x in a[1] if x not in set(b[1])][:2]} {[x for x in b[1] if x not in set(a[1])][:2]}"
    for x, y in zip(a[1], b[1], strict=True):
        if x != y and not _close(x, y):
            return f"{x} and {y}"
    return ""


def _close(x, y) -> bool:
    if isinstance(x, tuple) and isinstance(y, tuple):
        return len(x) == len(y) and all(_close(p, q) for p, q in zip(x, y, strict=True))
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-9)
    return x == y

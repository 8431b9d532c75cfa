"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"create view {path.stem} as select * from read_parquet('{source}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ("null", "")
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", str(value))
    if isinstance(value, float):
        return ("float", f"{value:.6g}" if value else "0")
    if isinstance(value, decimal.Decimal):
        return ("float", f"{float(value):.6g}")
    if isinstance(value, datetime.datetime):
        return ("time", value.replace(tzinfo=None).isoformat())
    if isinstance(value, (list, tuple)):
        return ("list", tuple(plain(v) for v in value))
    return (type(value).__name__, str(value))


def difference(frame, con, sql: str) -> str:
    """What differs, or an empty string."""
    mine = frame.collect()
    found = con.execute(sql)
    theirs, names = found.fetchall(), [d[0] for d in found.description]
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in mine), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in theirs), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{dict(zip(order, x))} against {dict(zip(order, y))}"
    return ""

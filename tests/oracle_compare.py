"""Run registered queries next to their SQL twins and compare the rows."""

from __future__ import annotations

import math
import time
from collections import Counter
from datetime import date, datetime

import duckdb

from catalog.views import BASE_TABLES


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, float):
        return None if math.isnan(value) else ("float", float(f"{value:.9g}"))
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, datetime):
        return ("time", value.isoformat())
    if isinstance(value, date):
        return ("date", value.isoformat())
    if value is None:
        return None
    return (type(value).__name__, str(value))


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(con, df, sql: str) -> tuple[str, dict]:
    """'' when equal, else what differs."""
    started = time.time()
    ours = df.collect()
    spent = time.time() - started
    started = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    info = {"rows": len(ours), "spark": round(spent, 2), "duck": round(time.time() - started, 2)}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}", info
    left, right = bag(df.columns, ours), bag(names, theirs)
    if left != right:
        only_left, only_right = left - right, right - left
        return (
            f"rows {len(ours)} against {len(theirs)}; only ours {sum(only_left.values())} e.g. {list(only_left)[:2]}; "
            f"only theirs {sum(only_right.values())} e.g. {list(only_right)[:2]}"
        ), info
    return "", info

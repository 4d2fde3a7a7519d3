"""Compare a query with its SQL counterpart, value by value."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value


def rows_of(names: list[str], rows: list) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(
        tuple(_plain(row[i]) for i in order) for row in rows
    )


def difference(df, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if equal as multisets, else a short description."""
    names, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = connection.execute(sql)
    other_names, theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if names != other_names:
        return f"columns {names} / {other_names}"
    if mine == theirs:
        return None
    only_mine, only_theirs = mine - theirs, theirs - mine
    return (
        f"{sum(mine.values())} / {sum(theirs.values())} rows, "
        f"only here {list(only_mine.items())[:2]}, only there {list(only_theirs.items())[:2]}"
    )

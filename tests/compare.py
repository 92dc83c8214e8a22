"""Run a query and its SQL on the same files and compare rows as multisets."""

from __future__ import annotations

import math
import os
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, int):
        return value
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql):
    """(number of Spark rows, message or None)."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = _rows(names, result.fetchall())
    got_rows = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return len(got_rows), f"columns {sorted(df.columns)} != {sorted(names)}"
    got = _rows(df.columns, got_rows)
    if got == expected:
        return len(got_rows), None
    extra, lacking = got - expected, expected - got
    return len(got_rows), (
        f"{sum(extra.values())} rows only in Spark, {sum(lacking.values())} only in SQL; "
        f"columns {sorted(names)}; Spark {list(extra)[:3]}; SQL {list(lacking)[:3]}"
    )

"""Spark results held against DuckDB's, as multisets of rows with columns by name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(names: list[str], found) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_cell(r[i]) for i in order) for r in found)


def difference(df, con, sql: str) -> str:
    """Empty if both give the same rows under the same names."""
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    theirs = rows(theirs_names, cursor.fetchall())
    ours = rows(df.columns, df.collect())
    if sorted(df.columns) != sorted(theirs_names):
        return f"columns {sorted(df.columns)} and {sorted(theirs_names)}"
    more, less = ours - theirs, theirs - ours
    if more or less:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list(more)[:2]}; only there {list(less)[:2]}"
    return ""

"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, int):
        return v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if hasattr(v, "as_integer_ratio"):
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def difference(df, con, sql: str) -> str:
    """Empty when equal, else a short description."""
    got, gcols = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want, wcols = rows_of([c[0] for c in cur.description], cur.fetchall())
    if gcols != wcols:
        return f"columns {gcols} != {wcols}"
    if got == want:
        return ""
    extra, missing = got - want, want - got
    return (
        f"{sum(got.values())} rows vs {sum(want.values())}; only spark {sum(extra.values())}: "
        f"{list(extra)[:2]!r}; only sql {sum(missing.values())}: {list(missing)[:2]!r}"[:1500]
    )

"""Comparison of a query with its SQL, as the driver does it."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def difference(df, con, sql: str) -> str:
    """Empty if both give the same rows."""
    columns = sorted(df.columns)
    got = con.execute(f"SELECT * FROM ({sql})")
    names = [d[0] for d in got.description]
    if sorted(names) != columns:
        return f"columns {columns} and {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(repr(tuple(plain(r[i]) for i in order)) for r in got.fetchall())
    have = Counter(repr(tuple(plain(v) for v in r)) for r in df.select(*columns).collect())
    if want == have:
        return ""
    return f"{sum(have.values())} and {sum(want.values())} rows; only here {list((have - want).items())[:3]}; only there {list((want - have).items())[:3]}"

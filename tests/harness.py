"""Compare a query with its oracle on one folder of tables."""
from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_rows(sql: str, path: str):
    con = duckdb.connect()
    for name in TABLES:
        file = Path(path) / f"{name}.parquet"
        if file.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) if value != int(value) else int(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(df, sql: str, path: str) -> str | None:
    """None when both sides agree, else a short account of the difference."""
    names, rows = oracle_rows(sql, path)
    got_names = df.columns
    if sorted(names) != sorted(got_names):
        return f"columns {sorted(got_names)} != {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(n)]) for n in order) for r in rows)
    got = Counter(tuple(plain(r[n]) for n in order) for r in df.collect())
    if want == got:
        return None
    missing, extra = list((want - got).items())[:3], list((got - want).items())[:3]
    return f"rows {sum(got.values())} != {sum(want.values())} cols {order}\n oracle only {missing}\n spark only {extra}"

"""Compare a named query with its DuckDB check on one scale folder."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else round(f, 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str):
    """(ok, message) of the order-insensitive comparison."""
    s_cols, s_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    d_cols, d_rows = _rows([d[0] for d in cur.description], cur.fetchall())
    if s_cols != d_cols:
        return False, f"columns {s_cols} != {d_cols}"
    if s_rows != d_rows:
        s_set, d_set = set(map(repr, s_rows)), set(map(repr, d_rows))
        return False, (
            f"rows {len(s_rows)} vs {len(d_rows)}; only spark {sorted(s_set - d_set)[:4]}; only duckdb {sorted(d_set - s_set)[:4]}"
        )
    return True, f"{len(s_rows)} rows"

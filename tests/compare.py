"""Compare a query with its reference SQL: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb

from areaspark.queries.registry import BASE


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return v + 0.0 if v != 0 else 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def spark_rows(df) -> tuple[list[str], Counter]:
    cols = sorted(df.columns)
    at = [df.columns.index(c) for c in cols]
    return cols, Counter(tuple(plain(r[i]) for i in at) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter, dict[str, str]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall()), kinds


KINDS = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date",
}


def differences(df, con, sql: str) -> list[str]:
    out = []
    cols, got = spark_rows(df)
    want_cols, want, kinds = duck_rows(con, sql)
    if cols != want_cols:
        return [f"columns {cols} != {want_cols}"]
    types = dict(df.dtypes)
    for c in cols:
        if KINDS.get(kinds[c], kinds[c]) != types[c]:
            out.append(f"type of {c}: {types[c]} != {kinds[c]}")
    if got != want:
        extra, lost = got - want, want - got
        out.append(f"rows {sum(got.values())} vs {sum(want.values())}; {sum(extra.values())} extra, {sum(lost.values())} lost")
        key = lambda r: tuple(str(x) for x in r)
        out += [f"  + {r}" for r in sorted(extra, key=key)[:3]] + [f"  - {r}" for r in sorted(lost, key=key)[:3]]
    if not sum(want.values()):
        out.append("no rows at all")
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))

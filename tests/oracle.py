"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def difference(query, sql: str, spark, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    found = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = duck(sf_dir).execute(sql)
    have = [d[0] for d in cur.description]
    if sorted(have) != names:
        return f"columns {names} and {sorted(have)}"
    at = [have.index(c) for c in names]
    wanted = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    return "" if found == wanted else f"{found.total()} and {wanted.total()} rows; only found {list((found - wanted).items())[:3]}, only wanted {list((wanted - found).items())[:3]}"

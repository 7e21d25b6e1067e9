"""Run a query in Spark and its twin in DuckDB and compare names, counts and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(x[i]) for i in order) for x in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    other = rows_of(names, cur.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} and {sorted(names)}")
    if len(mine) != len(other):
        out.append(f"rows {len(mine)} and {len(other)}")
    diff = [(a, b) for a, b in zip(mine, other, strict=False) if a != b]
    if diff:
        out.append(f"{len(diff)} rows differ, first: {diff[0]}")
    return out

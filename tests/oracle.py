"""Runs a query's DuckDB SQL on the same tables and compares rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, int):
        return float(x) if not isinstance(x, bool) else x
    return str(x) if not isinstance(x, (bool, str, type(None))) else x


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def compare(spark, query, sql: str, sf_dir: str) -> tuple[int, str]:
    """Number of rows, and what differs (empty if nothing does)."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    answer = connection(sf_dir).execute(sql)
    columns = [d[0] for d in answer.description]
    theirs = rows(columns, answer.fetchall())
    if sorted(columns) != sorted(df.columns):
        return len(mine), f"columns {sorted(df.columns)} and {sorted(columns)}"
    if mine != theirs:
        only = [r for r in mine if r not in set(theirs)][:3], [r for r in theirs if r not in set(mine)][:3]
        return len(mine), f"{len(mine)} and {len(theirs)} rows; {only}"
    return len(mine), ""

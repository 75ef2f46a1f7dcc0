"""Compares a query with its SQL, as the driver does."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def cell(x):
        if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return str([cell(y) for y in x])
        if x is None or x is pd.NA or isinstance(x, float) and x != x:
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        try:
            return f"{float(x):.5f}" if not isinstance(x, str) else x
        except (TypeError, ValueError):
            return str(x)

    columns = sorted(df.columns)
    return sorted("|".join(cell(x) for x in r) for r in df[columns].itertuples(index=False))


def same(spark_df, con, sql: str) -> tuple[bool, str]:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        left, right = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return False, f"{len(a)} and {len(b)} rows; {left} {right}"
    return True, f"{len(a)} rows"

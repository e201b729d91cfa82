"""Compare a Spark result with DuckDB's on the same Parquet tables."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows by value, dates as text."""
    df = df[sorted(df.columns)].copy()
    for name in df.columns:
        if name == "date":
            df[name] = pd.to_datetime(df[name]).dt.strftime("%Y-%m-%d")
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, wanted: pd.DataFrame) -> str | None:
    """What differs, or None; values must be equal, not close."""
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} != {sorted(wanted.columns)}"
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}"
    got, wanted = normal(got), normal(wanted)
    for name in got.columns:
        a, b = got[name], wanted[name]
        bad = ~((a == b) | (a.isna() & b.isna()))
        if bad.any():
            return f"{name}: {int(bad.sum())} differ, first {a[bad].iloc[0]} != {b[bad].iloc[0]}"
        if a.dtype.kind != b.dtype.kind:
            return f"{name}: type {a.dtype} != {b.dtype}"
    return None

"""Side-by-side run of a query and its SQL check."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TESTDATA = os.environ.get("LEDGERLINE_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.astype(object).where(df.notna(), None)
    rows = sorted((tuple(str(v) for v in r) for r in df.itertuples(index=False)))
    return pd.DataFrame(rows, columns=df.columns)


def difference(actual: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    """None when both hold the same rows, else what differs."""
    if sorted(actual.columns) != sorted(expected.columns):
        return f"columns {sorted(actual.columns)} != {sorted(expected.columns)}"
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    a, e = canonical(actual), canonical(expected)
    if a.equals(e):
        return None
    odd = (a != e).any(axis=1)
    return f"{odd.sum()} of {len(a)} rows differ\n{a[odd].head(4).to_string()}\n{e[odd].head(4).to_string()}"

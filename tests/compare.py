"""Runs a query on Spark and its SQL on DuckDB and compares their rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    columns = sorted(got.columns)
    key = lambda df: df[columns].astype(object).where(df[columns].notna(), None).sort_values(columns, key=lambda s: s.astype(str)).reset_index(drop=True)
    text = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    a, b = ({tuple(map(text, r)) for r in key(x).itertuples(index=False)} for x in (got, want))
    return "" if a == b else f"{len(a - b)} rows differ: {sorted(a - b)[:2]} {sorted(b - a)[:2]}"

"""Rows of a query and of its SQL counterpart, in a form that can be compared."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def comparable(df: pd.DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    names = sorted(df.columns)
    df = df.convert_dtypes(convert_string=False)  # whole numbers beside nulls are integers in both engines

    def text(value) -> str:
        if pd.isna(value):
            return "null"
        return repr(round(float(value), 6)) if isinstance(value, float) else str(value)

    return names, sorted(tuple(map(text, row)) for row in df[names].itertuples(index=False))

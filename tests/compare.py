"""Compares a query with its SQL on the same tables."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        source = f if os.path.isfile(f) else f"{f}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{source}'")
    return con


def normal(df):
    df = df[sorted(df.columns)].copy()

    def text(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        return f"{x:.5f}" if isinstance(x, float) else str(x)

    for c in df.columns:
        df[c] = df[c].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got, want):
    a, b = normal(got), normal(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    assert (a.to_numpy() == b.to_numpy()).all()

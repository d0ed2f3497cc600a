"""Comparison of a query with its SQL twin on DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, (list, np.ndarray)):
        return str([_text(x) for x in v])
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_text(v) for v in r) for r in df[cols].itertuples(index=False))


def assert_same(spark, sf, query, sql):
    assert rows(query(spark, sf).toPandas()) == rows(connect(sf).execute(sql).df())

"""Compares a query with its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pandas as pd


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
        return "-"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_cell(x) for x in v])
    return v.isoformat() if isinstance(v, pd.Timestamp) else str(v)


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False, name=None))


def connection(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def same(spark, query, sql, sf_dir):
    got = _rows(query(spark, sf_dir).toPandas())
    expected = _rows(connection(sf_dir).sql(sql).to_arrow_table().to_pandas())
    assert got[0] == expected[0]
    assert got[1] == expected[1]

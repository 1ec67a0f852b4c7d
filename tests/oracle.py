"""Runs a query and its SQL twin and compares the rows, whatever their order."""

import os

import duckdb
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def cells(df):
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return f"{float(v):.10g}" if isinstance(v, float) else str(v)

    out = df[sorted(df.columns)].map(one)
    return sorted(map(tuple, out.itertuples(index=False)), key=str)


def same(spark, sf_dir, query, sql):
    a, b = query(spark, sf_dir).toPandas(), connection(sf_dir).execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert cells(a) == cells(b)

"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows as bags."""

import os
from collections import Counter

import duckdb
import pandas as pd


def plain(v):
    if isinstance(v, (list, dict, tuple)) or hasattr(v, "shape") and v.shape:
        return str(v)
    if v is None or v is pd.NA or pd.isna(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(v, float) and abs(v) < 1e15 and v == int(v) else v


def bag(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None))


def check(spark, sf, query, sql):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    a, b = bag(query(spark, sf).toPandas()), bag(con.execute(sql).fetchdf())
    assert a[0] == b[0]
    assert a[1] == b[1], (list((a[1] - b[1]).items())[:3], list((b[1] - a[1]).items())[:3])

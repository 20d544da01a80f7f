"""Compares a query with its SQL on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].dt.strftime("%Y-%m-%d %H:%M:%S")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None else (str(x) + " 00:00:00" if type(x).__name__ == "date" else str(x)))
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


def same(query, sql, spark, sf):
    a, b = query(spark, sf).toPandas(), connect(sf).execute(sql).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b) > 0 or len(a) == len(b)
    a, b = plain(a), plain(b)
    for c in a.columns:
        if a[c].dtype.kind in "fi" and b[c].dtype.kind in "fi":
            pd.testing.assert_series_equal(a[c].astype(float), b[c].astype(float), check_dtype=False, rtol=1e-9, atol=1e-9)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c

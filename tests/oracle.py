"""Compares a query with its SQL on the same tables in DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | int):
        return f"{float(v):.6f}"
    return str(v)


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(repr, map(_plain, r))) for r in frame.itertuples(index=False))


def assert_same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql).df()
    got = query(spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    con.close()
    want, got = want.where(want.notna(), None), got.where(got.notna(), None)
    assert rows_of(got) == rows_of(want)

"""Query results against the same SQL in another engine."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.execute(sql).df()


def text(v):
    if v is None or v is pd.NaT or v != v:
        return "~"
    return repr(float(v)) if type(v).__name__ in ("Decimal", "float", "float64") else str(v)


def plain(frame):
    columns = sorted(frame.columns)
    return frame[columns].map(text).sort_values(columns).reset_index(drop=True)


def assert_same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    if len(got):
        pd.testing.assert_frame_equal(plain(got), plain(want))

"""Runs the oracle SQL in DuckDB and compares rows, order and float noise aside."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def text(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, (float, np.floating)) and x != x:
        return "NULL"
    if isinstance(x, (float, np.floating)):
        return str(int(x)) if float(x).is_integer() else f"{x:.6g}"
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(text, x)) + "]"
    return str(int(x)) if isinstance(x, np.integer) else str(x)


def rows(df):
    return sorted("|".join(map(text, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))

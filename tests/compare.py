"""Order-free comparison of a Spark query with its SQL on DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def views(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canonical(df):
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or isinstance(v, float) and np.isnan(v):
            return None
        if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)):
            return f"{float(v):.6g}"
        return str(v)

    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False)), key=repr)

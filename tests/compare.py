"""Rows of a query and of its SQL in DuckDB, in one comparable form."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def duck(sf_dir: str = SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or v != v:
            return None
        return (0.0 if abs(v) < 1e-12 else float(f"{v:.9g}")) if isinstance(v, float) else (int(v) if hasattr(v, "__int__") and not isinstance(v, (str, bool)) and not math.isnan(float(v)) else v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(one(v) for v in r) for r in frame.itertuples(index=False)), key=repr)

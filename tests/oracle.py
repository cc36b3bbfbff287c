"""Comparing a query with its SQL."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connection(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "item"):
        return "[" + ",".join(map(_plain, v)) + "]"
    if hasattr(v, "shape") and v.shape:
        return "[" + ",".join(map(_plain, v.tolist())) + "]"
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "NULL"
    if isinstance(v, (bool, str)) or type(v).__name__ == "bool":
        return str(v)
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))

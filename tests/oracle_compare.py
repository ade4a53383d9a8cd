"""Rows of a query against rows of its SQL, without regard to order."""

from __future__ import annotations

import math
from datetime import datetime, time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str)):
        return v
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    if isinstance(v, datetime):
        return str(v.date()) if v.time() == time() else str(v)
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if not isinstance(v, bool) else v


def rows(frame: pd.DataFrame) -> tuple[list[str], list]:
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(_plain, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=str)

"""Compare a query with its SQL in DuckDB: columns, rows and values in any order."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _norm(v) -> str:
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_norm, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if v == int(v) else repr(round(float(v), 6))
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(v))
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(map(_norm, r)) for r in frame[columns].itertuples(index=False))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, (len(a), len(b), sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3])

"""Run a query on Spark and its SQL on DuckDB and compare rows, types and values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    nullable = {c: "float64" if frame[c].isna().any() else "int64" for c in frame.columns if str(frame[c].dtype) == "Int64"}
    frame = frame.astype(nullable)
    frame = frame.sort_values(list(frame.columns), ignore_index=True)
    return frame


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} / {len(sql_frame)}"
    left, right = canonical(spark_frame), canonical(sql_frame)
    for name in left.columns:
        a, b = left[name], right[name]
        if a.dtype != b.dtype and not (a.dtype == object or b.dtype == object):
            return f"{name}: type {a.dtype} / {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = int(np.flatnonzero(~same)[0])
            return f"{name}: {(~same).sum()} differ, first {a[at]!r} / {b[at]!r}"
    return None


def main(names: list[str], folder: str) -> None:
    root = Path(__file__).resolve().parents[1]
    sys.path[:0] = [str(root), str(root / "tests")]
    import __spark_entry__ as entry
    from conftest import make_session

    spark = make_session()
    connection = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or list(queries):
        start = time.time()
        try:
            result = queries[name](spark, folder).toPandas()
            outcome = f"rows only: {len(result)}"
            if name in oracles:
                found = difference(result, connection.sql(oracles[name]).df())
                outcome = f"ok {len(result)}" if found is None else f"DIFFERENT {found}"
        except Exception as error:  # report and go on with the next query
            outcome = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"CHECK {name:32s} {time.time() - start:7.2f}s  {outcome}", flush=True)


if __name__ == "__main__":
    main(sys.argv[2:], sys.argv[1])

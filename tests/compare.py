"""Run queries and their SQL side by side: ``python tests/compare.py <folder> [query ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        if frame[column].dtype.kind in "iuf":
            frame[column] = frame[column].astype("float64") if frame[column].isna().any() else frame[column]
    order = frame.astype(object).where(frame.notna(), None).astype(str).apply("\x1f".join, axis=1) if len(frame) else pd.Series([], dtype=str)
    return frame.iloc[np.argsort(order.to_numpy(), kind="stable")].reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """What differs first, or None."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    a, b = normal(ours), normal(theirs)
    for column in a.columns:
        whole = not (a[column].isna().any() or b[column].isna().any())
        if len(a) and whole and a[column].dtype.kind != b[column].dtype.kind:
            return f"{column}: {a[column].dtype} vs {b[column].dtype}"
        x, y = a[column].astype(object), b[column].astype(object)
        same = (x.isna() & y.isna()) | (x == y).fillna(False).astype(bool)
        if not same.all():
            i = int(np.flatnonzero(~same.to_numpy())[0])
            return f"{column} in {int((~same).sum())} rows: {a.iloc[i].to_dict()} vs {b.iloc[i].to_dict()}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as contract

    from jobvigil.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    folder, chosen = sys.argv[1], sys.argv[2:]
    connection = database(folder)
    for name, build in contract.queries().items():
        if chosen and name not in chosen:
            continue
        try:
            began = time.time()
            ours = build(spark, folder).toPandas()
            took = time.time() - began
            sql = contract.oracle_sql().get(name)
            if sql is None:
                print(f"#rows-only {name} {len(ours)} {took:.1f}s", flush=True)
                continue
            began = time.time()
            theirs = connection.sql(sql).df()
            problem = difference(ours, theirs)
            print(f"#{'ok' if problem is None else 'DIFF'} {name} {len(ours)} {took:.1f}s sql {time.time() - began:.1f}s "
                  f"{problem or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"#FAIL {name} {str(error)[:500]}", flush=True)

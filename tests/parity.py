"""Compare registered queries with their SQL twins: python tests/parity.py sf_dir [ids]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT:
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, float) and v != v:
            return None
        if isinstance(v, float) and v == int(v) if isinstance(v, float) and abs(v) < 1e15 else False:
            return int(v)
        return v

    return sorted((tuple(plain(v) for v in row) for row in frame.astype(object).itertuples(index=False)), key=repr)


def compare(con, sql: str, frame: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    want = con.execute(sql).df()
    if sorted(want.columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(want.columns)}"
    if len(want) != len(frame):
        return f"rows {len(frame)} against {len(want)}"
    a, b = rows_of(frame), rows_of(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from slipstack.session import local_session

    folder, ids = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in ids or queries:
        t = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            took = time.time() - t
            verdict = compare(con, oracles[name], got) if name in oracles else "(no sql)"
            print(f"{name:18s} {len(got):7d} rows {took:6.2f}s {time.time() - t - took:6.2f}s", verdict or "ok", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name:18s} FAILED {str(e)[:600]}", flush=True)

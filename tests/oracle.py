"""Compare queries with their SQL on DuckDB: columns, row count and sorted values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(tuple(_value(r[n]) for n in order) for r in rows)


def compare(spark, con, name: str, run, sql: str, folder: str) -> tuple[int, float]:
    """Rows compared and Spark seconds; raises AssertionError on a difference."""
    start = time.time()
    df = run(spark, folder)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    assert sorted(df.columns) == sorted(columns), (name, df.columns, columns)
    a, b = _rows(df.columns, got), _rows(columns, want)
    assert len(a) == len(b), (name, len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, (name, len(wrong), sorted(columns), wrong[:3])
    return len(a), seconds


if __name__ == "__main__":
    from conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    folder, only = sys.argv[1], sys.argv[2:]
    spark, con = make_session(), connect(folder)
    bad = 0
    for name, run in queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            n, seconds = compare(spark, con, name, run, oracle_sql()[name], folder)
            print(f"ok   {name:24} {n:8} rows {seconds:6.2f} s", flush=True)
        except Exception as error:
            bad += 1
            print(f"FAIL {name:24} {str(error)[:900]}", flush=True)
    sys.exit(bad > 0)

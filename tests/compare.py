"""Run registered queries next to their SQL in DuckDB and compare whole results.

Usage: python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else f"{v:.6f}")
    if isinstance(v, int):
        return (1, str(v))
    return (2, str(v))


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(columns, rows, sql_columns, sql_rows) -> list[str]:
    out = []
    if sorted(columns) != sorted(sql_columns):
        out.append(f"columns {sorted(columns)} != {sorted(sql_columns)}")
    if len(rows) != len(sql_rows):
        out.append(f"rows {len(rows)} != {len(sql_rows)}")
    if not out:
        a, b = canonical(columns, rows), canonical(sql_columns, sql_rows)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        if bad:
            out.append(f"{len(bad)} rows differ, first: {str(bad[0][0])[:300]} != {str(bad[0][1])[:300]}")
    return out


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con) -> tuple[list[str], float, float, int]:
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return [], took, 0.0, len(rows)
    start = time.time()
    cur = con.execute(sql)
    sql_columns = [d[0] for d in cur.description]
    sql_types = {d[0]: str(d[1]) for d in cur.description}
    sql_rows = cur.fetchall()
    out = differences(df.columns, rows, sql_columns, sql_rows)
    types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for column, dtype in df.dtypes:
        want = sql_types.get(column, "")
        if want and types.get(dtype, want) != want and not (dtype == "string" and want == "STRING"):
            out.append(f"type of {column}: {dtype} vs {want}")
    return out, took, time.time() - start, len(rows)


if __name__ == "__main__":
    from casebook.session import build_session
    from casebook.suite import QUERIES, SQL

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0] == "--sf":
        sf_dir, args = args[1], args[2:]
    spark = build_session("compare", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = []
    for name in args or list(QUERIES):
        try:
            out, took, sql_took, n = compare(spark, sf_dir, name, QUERIES[name], SQL.get(name), con)
        except Exception as exc:  # report and go on with the next query
            out, took, sql_took, n = [f"{type(exc).__name__}: {str(exc)[:600]}"], 0.0, 0.0, 0
        mark = "FAIL" if out else ("ok  " if name in SQL else "rows")
        print(f"{mark} {name:32s} {n:8d} rows {took:6.2f}s sql {sql_took:5.2f}s {'; '.join(out)}", flush=True)
        if out:
            failed.append(name)
    print("failed:", failed)

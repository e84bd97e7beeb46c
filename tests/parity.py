"""Compare Spark queries with their DuckDB statements, value by value.

Run as a script: ``python tests/parity.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
from glob import glob

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _cell(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, dt.datetime):
        return x.date() if (x.hour, x.minute, x.second) == (0, 0, 0) else x
    if isinstance(x, float) and x == 0:
        return 0.0
    return x


def _rows(rows, order):
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


KIND = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "DATE": "date", "BOOLEAN": "boolean",
}


def compare(spark_df, con, sql) -> str | None:
    """None when equal, else what differs."""
    rel = con.sql(sql)
    cols, types = list(rel.columns), [str(t) for t in rel.types]
    expected = rel.fetchall()
    names = sorted(spark_df.columns)
    if names != sorted(cols):
        return f"columns: only spark {set(names) - set(cols)}, only sql {set(cols) - set(names)}"
    got = [tuple(r) for r in spark_df.collect()]
    a = _rows(got, [spark_df.columns.index(n) for n in names])
    b = _rows(expected, [cols.index(n) for n in names])
    if len(a) != len(b):
        return f"rows: {len(a)} != {len(b)}"
    bad = [i for i in range(len(a)) if a[i] != b[i]]
    if bad:
        i = bad[0]
        diff = [(n, x, y) for n, x, y in zip(names, a[i], b[i]) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, first: {diff[:6]}"
    spark_types = dict(spark_df.dtypes)
    wrong = [
        (n, spark_types[n], t) for n, t in zip(cols, types) if KIND.get(t, t) != spark_types[n]
    ]
    return f"types: {wrong}" if wrong else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from emberline.plans.oracle import SQL
    from emberline.plans.registry import QUERIES
    from emberline.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = sys.argv[2:]
    spark = build_session(
        "parity", "local[8]", 8, {"spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                  "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    failed = 0
    for name, fn in QUERIES.items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in SQL:
                msg = compare(df, con, SQL[name]) or "ok"
            else:
                msg = f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            msg = f"ERROR {type(e).__name__}: {str(e)[:500]}"
        if msg != "ok":
            failed += 1
        print(f"{name:32s} {time.time() - t:6.2f}s {msg}", flush=True)
    print("not ok:", failed, "missing sql:", sorted(set(QUERIES) - set(SQL)),
          "orphans:", sorted(set(SQL) - set(QUERIES)))

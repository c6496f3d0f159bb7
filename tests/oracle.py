"""Run registered queries beside their SQL and compare the rows.

    python tests/oracle.py [name-prefix ...]      SF_DIR overrides the data folder
"""
from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def connection(folder: str = SF_DIR):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


def compare(spark, con, name, build, sql, folder: str = SF_DIR):
    """None when the rows agree, else a text; also the seconds Spark took."""
    start = time.time()
    df = build(spark, folder)
    ours = [tuple(row) for row in df.collect()]
    took = time.time() - start
    if sql is None:
        return (None if ours else "no rows"), took, len(ours)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(df.columns)} / {sorted(names)}", took, len(ours)
    if len(ours) != len(theirs):
        return f"row counts differ: {len(ours)} / {len(theirs)}", took, len(ours)
    a, b = sorted_rows(df.columns, ours), sorted_rows(names, theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first: {sorted(names)}\n   {bad[0][0]}\n   {bad[0][1]}", took, len(ours)
    return (None if ours else "no rows"), took, len(ours)


def main(prefixes):
    from tickloom.plans import ORACLES, QUERIES
    from tickloom.sources.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connection()
    failed = 0
    for name, build in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            problem, took, n = compare(spark, con, name, build, ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            problem, took, n = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0
        failed += problem is not None
        kind = "" if name in ORACLES else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {n} rows {took:.1f}s{kind} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

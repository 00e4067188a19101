"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle_check.py [--dir DIR] [name …]
"""

from __future__ import annotations

import datetime
import glob
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, detail, seconds) of one query."""
    start = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return sum(got.values()) > 0, f"{sum(got.values())} rows (no SQL)", took
    rel = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", took
    if got != want:
        extra, missing = got - want, want - got
        return False, (
            f"{sum(got.values())} vs {sum(want.values())} rows; extra {sum(extra.values())} "
            f"{list(extra)[:3]}; missing {sum(missing.values())} {list(missing)[:3]} {got_cols}"
        ), took
    return sum(want.values()) > 0, f"{sum(want.values())} rows", took


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--dir"]:
        sf_dir, args = args[1], args[2:]
    from __spark_entry__ import oracle_sql, queries
    from flightwords.session import local_session

    QUERIES, ORACLES = queries(), oracle_sql()

    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if args and name not in args:
            continue
        try:
            ok, detail, took = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, detail, took = False, f"{type(exc).__name__}: {str(exc)[:600]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {took:6.2f}s {detail[:1200]}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()

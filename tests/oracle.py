"""Run named queries in Spark and their check SQL in DuckDB and compare.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    """A value both engines print alike. Kind and value count: 1 and 1.0 differ."""
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return f"D{v}"
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, dict):
        return repr(sorted((k, cell(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return repr([cell(x) for x in v])
    return repr(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"rows only, {len(rows)} rows", took
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want_rows = rel.fetchall()
    got = canonical(df.columns, rows)
    want = canonical(names, want_rows)
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", took
    if len(got[1]) != len(want[1]):
        return False, f"{len(got[1])} rows, expected {len(want[1])}", took
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return False, f"{len(bad)} rows differ: got {bad[0][0]} expected {bad[0][1]}"[:900], took
    return True, f"{len(rows)} rows", took


def main():
    p = argparse.ArgumentParser()
    p.add_argument("names", nargs="*")
    p.add_argument("--sf", default="0.01")
    args = p.parse_args()
    from tabloom.plans import ORACLES, QUERIES
    from tabloom.session import build_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="12g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = []
    for name in args.names or list(QUERIES):
        hits = [n for n in QUERIES if n == name or (name.endswith("*") and n.startswith(name[:-1]))]
        for n in hits:
            try:
                ok, note, took = compare(spark, con, n, QUERIES[n], ORACLES.get(n), sf_dir)
            except Exception as exc:  # report every query, then fail at the end
                ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
            print(f"{'ok  ' if ok else 'FAIL'} {n:28s} {took:6.2f}s {note}", flush=True)
            if not ok:
                failed.append(n)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

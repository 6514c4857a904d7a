"""Runs queries and their SQL side by side; names as arguments, all without. Prints what differs."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if abs(v) >= 1e-9 else "0"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 2**53 else str(v)
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def main(names):
    import duckdb

    import __spark_entry__ as entry
    from tests.conftest import session

    spark = session()
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - t
            if name not in sqls:
                print(f"rows  {name}: {len(got)} in {took:.1f} s", flush=True)
                continue
            t = time.time()
            res = con.execute(sqls[name])
            cols = [d[0] for d in res.description]
            want = res.fetchall()
            if sorted(cols) != sorted(df.columns):
                raise AssertionError(f"columns {df.columns} and {cols}")
            a, b = rows_of(df.columns, got), rows_of(cols, want)
            if a != b:
                x, y = sorted(set(a) - set(b)), sorted(set(b) - set(a))
                raise AssertionError(f"{len(a)} and {len(b)} rows; only Spark {len(x)} {x[:2]}; only SQL {len(y)} {y[:2]}")
            kinds = lambda cs, rs: {c: {type(r[i]).__name__ for r in rs} - {"NoneType"} for i, c in enumerate(cs)}
            k1, k2 = kinds(df.columns, got), kinds(cols, want)
            if k1 != k2:
                print(f"kinds {name}: {[(c, k1[c], k2[c]) for c in k1 if k1[c] != k2[c]]}", flush=True)
            print(f"ok    {name}: {len(got)} in {took:.1f} s, SQL {time.time() - t:.1f} s", flush=True)
        except Exception as e:
            bad += 1
            print(f"BAD   {name}: {str(e)[:700]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)

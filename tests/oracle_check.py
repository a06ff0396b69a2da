"""Run every registered query on Spark and its oracle SQL on DuckDB, compare.

Usage: python tests/oracle_check.py [sf_dir] [query ...]

Comparison: same column names (sorted), same row count, and the same
multiset of rows after normalising values (dates/timestamps to ISO text,
decimals to float). Floats must be equal exactly.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return bool(v)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def compare(spark, sf_dir, names=None, verbose=True):
    from __spark_entry__ import oracle_sql, queries
    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        scols, srows = rows_of_spark(df)
        t1 = time.time()
        if name not in sqls:
            results[name] = ("rows-only", len(srows))
            if verbose:
                print(f"{name:28s} rows-only  rows={len(srows)}  spark={t1 - t0:.2f}s")
            continue
        dcols, drows = rows_of_duck(con, sqls[name])
        ok_cols = scols == dcols
        ok_n = len(srows) == len(drows)
        cs, cd = Counter(srows), Counter(drows)
        ok_v = cs == cd
        results[name] = ("ok" if (ok_cols and ok_n and ok_v) else "MISMATCH", len(srows))
        if verbose:
            print(f"{name:28s} {results[name][0]:9s} rows={len(srows)}/{len(drows)} "
                  f"cols={'ok' if ok_cols else (scols, dcols)} spark={t1 - t0:.2f}s")
            if not ok_v and ok_cols:
                only_s = list((cs - cd).elements())[:3]
                only_d = list((cd - cs).elements())[:3]
                print("   spark-only:", only_s)
                print("   duck-only: ", only_d)
    return results


if __name__ == "__main__":
    from tally.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] == "MISMATCH"]
    print("MISMATCHES:", bad)
    sys.exit(1 if bad else 0)

"""Compare registered queries with their SQL on one scale of the given tables.

    python check.py [--sf 0.01] [query or catalog module ...]

Both results are compared as multisets of rows, columns in name order.
"""

from __future__ import annotations

import argparse
import decimal
import os
import sys
import time
from collections import Counter

import duckdb

from faultatlas.session import local_session

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    return value


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(normal(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    from faultatlas.plans.catalog import QUERIES

    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    bad = 0
    modules = {f.__module__.rsplit(".", 1)[1] for f, _ in QUERIES.values()}
    names = [
        n for n in QUERIES
        if not args.names or n in args.names or QUERIES[n][0].__module__.rsplit(".", 1)[1] in set(args.names) & modules
    ]
    for name in names:
        function, sql = QUERIES[name]
        began = time.time()
        try:
            df = function(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - began
            if sql is None:
                print(f"rows  {name}: {len(rows)} rows {took:.1f}s", flush=True)
                bad += not rows
                continue
            result = con.execute(sql)
            wanted_columns = [d[0] for d in result.description]
            wanted = multiset(wanted_columns, result.fetchall())
            got = multiset(df.columns, rows)
        except Exception as problem:  # report and go on with the next query
            print(f"ERROR {name}: {str(problem)[:1500]}", flush=True)
            bad += 1
            continue
        if got == wanted:
            print(f"ok    {name}: {len(rows)} rows {took:.1f}s", flush=True)
            continue
        bad += 1
        print(f"DIFF  {name}: {len(rows)} rows, wanted {sum(wanted[1].values())}; columns {got[0]} / {wanted[0]}")
        if got[0] == wanted[0]:
            for label, extra in (("only spark", got[1] - wanted[1]), ("only sql", wanted[1] - got[1])):
                for row in list(extra)[:3]:
                    print(f"      {label}: {row}", flush=True)
    print(f"{bad} not equal")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

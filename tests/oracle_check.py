"""Run registered queries beside their SQL and compare the results.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(value):
    if value is None:
        return "\x00null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(cell, value)) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, make, sql):
    """(spark rows, sql rows, error or None)"""
    df = make(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return len(got), None, None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(got), len(want), f"columns {sorted(df.columns)} vs {sorted(names)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lacks = [r for r in want if r not in set(got)][:2]
        return len(got), len(want), f"rows differ\n   only spark {extra}\n   only sql   {lacks}"
    return len(got), len(want), None


def main():
    import __spark_entry__ as entry
    from sitelore.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    oracles, bad = entry.oracle_sql(), []
    for name, make in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            n, m, err = compare(spark, con, sf_dir, name, make, oracles.get(name))
        except Exception as e:  # report and go on with the next query
            n, m, err = 0, 0, f"{type(e).__name__}: {str(e)[:1500]}"
        spark.catalog.clearCache()
        print(f"{'FAIL' if err else 'ok  '} {name:24} spark={n} sql={m} {time.time() - start:.1f}s {err or ''}"[:2500], flush=True)
        if err:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()

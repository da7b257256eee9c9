"""Run registered queries next to their SQL in DuckDB and compare the results.

usage: python tools/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from renewlens.plans import catalog
from renewlens.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    data = [tuple(normal(r[i]) for i in order) for r in rows]
    return names, sorted(data, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name):
    """Returns (status, rows, seconds, detail)."""
    start = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if name not in catalog.ORACLES:
        return "rows", len(rows), seconds, ""
    result = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    types = dict(zip(names, [str(d[1]) for d in result.description]))
    a, b = table(df.columns, rows), table(names, result.fetchall())
    if a[0] != b[0]:
        return "FAIL", len(rows), seconds, f"columns {a[0]} vs {b[0]}"
    if len(a[1]) != len(b[1]):
        return "FAIL", len(rows), seconds, f"rows {len(a[1])} vs {len(b[1])}"
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
    odd = [
        (c, t, types[c])
        for c, t in df.dtypes
        if kinds.get(t) not in (types[c], {"NUMBER": None}.get(types[c])) and types[c] not in ("NUMBER", "STRING")
    ]
    for x, y in zip(a[1], b[1]):
        if x != y:
            diff = [(n, p, q) for n, p, q in zip(a[0], x, y) if p != q]
            return "FAIL", len(rows), seconds, f"{diff[:4]}"
    return "ok", len(rows), seconds, f"types {odd}" if odd else ""


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(catalog.QUERIES)
    spark = build_session(
        master="local[8]",
        conf={
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, total = duck(sf_dir), [], time.time()
    for n in names:
        try:
            status, rows, seconds, detail = compare(spark, con, sf_dir, n)
        except Exception as e:  # report and go on with the next query
            status, rows, seconds, detail = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:700]}"
        if status in ("FAIL", "ERROR"):
            bad.append(n)
        print(f"{status:5} {n:32} rows={rows:<7} {seconds:6.2f}s {detail}", flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} fine in {time.time() - total:.0f}s; bad: {bad}")
    spark.stop()
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()

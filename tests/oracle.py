"""Compare registered queries with their SQL twins: python tests/oracle.py [sf] [names...]."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TESTDATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, name: str, run, sql: str | None) -> str:
    df = run(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows={len(mine)} (no oracle)"
    cursor = connect(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = _rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        raise AssertionError(f"{name}: columns {sorted(df.columns)} and {sorted(names)}")
    if len(mine) != len(theirs):
        raise AssertionError(f"{name}: {len(mine)} rows and {len(theirs)}; {sorted(names)}; first {mine[:2]} / {theirs[:2]}")
    for a, b in zip(mine, theirs):
        if a != b:
            raise AssertionError(f"{name}: {sorted(names)}\n  {str(a)[:700]}\n  {str(b)[:700]}")
    return f"rows={len(mine)} equal"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", os.environ.get("WAREHOUSE", "/tmp/leafmill-warehouse"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    oracles, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if args[1:] and name not in args[1:]:
            continue
        start = time.time()
        try:
            said = compare(spark, f"{TESTDATA}/sf{sf}", name, run, oracles.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            failed += 1
            said = f"FAILED {type(exc).__name__}: {str(exc)[:1800]}"
        print(f"{name:28s} {time.time() - start:6.2f}s {said}", flush=True)
    print("failed:", failed)

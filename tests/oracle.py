"""Runs a registered query in Spark and its oracle in DuckDB and compares every value."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from sojourn.plans import ORACLES, QUERIES


def spark_session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("sojourn-tests")
        .config("spark.sql.shuffle.partitions", os.environ.get("TEST_PARTITIONS", "8"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", os.environ.get("TEST_ZONE", "UTC"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([r[i] for i in order]) for r in rows)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> tuple[str, float]:
    """Empty text when equal, else the first difference."""
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got_cols, got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if name not in ORACLES:
        return ("" if got else "no rows"), took
    cur = con.execute(ORACLES[name])
    want_cols, want = _canonical([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", took
    if got != want:
        only_got = [r for r in got if r not in set(want)][:2]
        only_want = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} vs {len(want)}\n   spark {only_got}\n   duck  {only_want}", took
    return ("" if got else "both empty"), took


if __name__ == "__main__":
    names = [a for a in sys.argv[1:] if a[0] not in "/@"]
    for module in (a[1:] for a in sys.argv[1:] if a[0] == "@"):
        names += [n for n, q in QUERIES.items() if q.__module__ == f"sojourn.plans.{module}"]
    names = names or list(QUERIES)
    sf = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    session, con = spark_session(), duck(sf)
    session.sparkContext.setLogLevel("ERROR")
    bad = 0
    for n in names:
        try:
            text, took = compare(session, con, n, sf)
        except Exception as e:  # report and go on with the next query
            text, took = f"{type(e).__name__}: {str(e)[:600]}", 0.0
        bad += bool(text)
        print(f"{'ok  ' if not text else 'FAIL'} {took:6.2f}s {n} {text}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")

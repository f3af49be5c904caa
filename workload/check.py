"""Compare registered queries with their SQL: python -m workload.check [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from workload.registry import ORACLE, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows) -> list[tuple]:
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else v + 0.0
        return v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str:
    t = time.time()
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = normal(df.select(*[f"`{c}`" for c in cols]).collect())
    took = time.time() - t
    if name not in ORACLE:
        return f"rows-only {len(got)} rows {took:.1f}s"
    t = time.time()
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = normal([tuple(r[i] for i in order) for r in cur.fetchall()])
    oracle = time.time() - t
    if [names[i] for i in order] != cols:
        return f"FAIL columns {cols} != {[names[i] for i in order]}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"FAIL {len(got)} vs {len(want)} rows, e.g. {bad}"
    types = {c: str(df.schema[c].dataType.simpleString()) for c in cols}
    kinds = {names[i]: str(cur.description[i][1]) for i in order}
    odd = {c: (types[c], kinds[c]) for c in cols if kinds[c].upper() in ("HUGEINT", "DECIMAL") or "DECIMAL" in kinds[c].upper()}
    return f"ok {len(got)} rows {took:.1f}s (oracle {oracle:.1f}s) {odd or ''}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = session(os.environ.get("BENCH_CPUS", "8")), duck(sf_dir)
    failed = 0
    for name in names:
        try:
            line = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            line = f"FAIL {type(e).__name__}: {str(e)[:600]}"
        failed += line.startswith("FAIL")
        print(f"{name:26s} {line}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()

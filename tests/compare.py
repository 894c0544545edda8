"""Run registered queries and their SQL oracles side by side: ``python tests/compare.py DIR [NAME..]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as E  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _value(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else None
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(spark: SparkSession, name: str, sf: str):
    df = E.queries()[name](spark, sf)
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()])


def oracle_rows(name: str, sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    return sorted(names), _rows(names, cur.fetchall())


def main() -> int:
    from shopcat.session import configure

    sf, names = sys.argv[1], sys.argv[2:] or list(E.queries())
    spark = configure(SparkSession.builder.master("local[8]")).config(
        "spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config(
        "spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            cols, got = spark_rows(spark, name, sf)
            took = time.time() - start
            if name not in E.oracle_sql():
                print(f"{name}: {len(got)} rows, no oracle, {took:.1f}s", flush=True)
                continue
            want_cols, want = oracle_rows(name, sf)
            ok = cols == want_cols and got == want
            print(f"{name}: {'ok' if ok else 'DIFFERS'} {len(got)}/{len(want)} rows {took:.1f}s", flush=True)
            if not ok:
                bad += 1
                if cols != want_cols:
                    print("  columns", cols, want_cols)
                a, b = set(map(repr, got)), set(map(repr, want))
                print("  only spark ", sorted(a - b)[:3])
                print("  only oracle", sorted(b - a)[:3])
        except Exception as e:
            bad += 1
            print(f"{name}: FAIL {str(e)[:800]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())

"""Runs every query in Spark and its SQL in DuckDB and compares the rows.

    python -m checks.verify [sf directory] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from .catalog import QUERIES, SQL
from .feeds import TABLES


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("checks")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(r[i]) for i in order) for r in rows)


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = argv[1:] or list(QUERIES)
    spark = session()
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = 0
    for name in chosen:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - started
            if name not in SQL:
                print(f"{name:28} rows={sum(mine.values())} {took:.1f}s (no SQL)")
                continue
            cursor = duck.execute(SQL[name])
            names = [c[0] for c in cursor.description]
            theirs = rows_of(names, cursor.fetchall())
            same = sorted(names) == sorted(df.columns) and mine == theirs
        except Exception as error:  # report and go on with the other queries
            failed += 1
            print(f"{name:28} FAILED {type(error).__name__}: {str(error)[:600]}")
            continue
        print(f"{name:28} {'ok  ' if same else 'DIFF'} rows={sum(mine.values())} {took:.1f}s")
        if not same:
            failed += 1
            print("   columns", sorted(df.columns), sorted(names))
            print("   only Spark", list((mine - theirs).items())[:3], sum((mine - theirs).values()))
            print("   only SQL  ", list((theirs - mine).items())[:3], sum((theirs - mine).values()))
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

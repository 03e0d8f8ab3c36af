"""Times the headline queries and prints one JSON line.

Every query runs twice, with Spark's default shuffle partitions and adaptive execution.
The total is of the second runs, in which the query's code is compiled; first runs are
listed beside them.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "compare_business_key", "run_log_levels", "net_price_mismatch", "field_diff", "field_diff_hot_keys",
    "positional_diff", "invoice_rules", "dq_summary", "findings_topn", "normalise_number",
    "canonical_map_right", "import_findings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times, first = {}, {}
    for name in chosen:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(round(time.perf_counter() - started, 3))
        first[name], times[name] = runs
        print(name, *runs, file=sys.stderr)
    print(json.dumps({
        "metric": "total seconds of the headline queries, second run of each", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "first_runs": first, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()

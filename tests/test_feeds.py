"""The feeds that the checks write as files."""

import csv
import glob
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import catalog, feeds
from twinledger import staging
from twinledger.sources import feeds as sources
from twinledger.sources import sinks


@pytest.fixture
def lineitem(spark, tmp_path):
    """A folder with a lineitem table whose keys repeat, and whose text is in another order than its numbers."""
    rows = [(order, part, supplier, line, 1.0 + part, 100.0 * part, "N", "F", datetime(1995, 1, 1 + part))
            for order in (None, 2, 1) for line in (2, 1) for part, supplier in ((9, 8), (10, 8), (11, 3), (2, 3), (9, 8))]
    spark.createDataFrame(rows, """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,
        l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp""").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("text", [feeds.NUMBERED_RIGHT, feeds.NOTES])
def test_numbered_files_are_ordered_by_keys_and_cells(spark, lineitem, text):
    path = catalog.as_numbered_csv(spark, lineitem, text).removeprefix("file://")
    whole = feeds.frame(spark, lineitem, text)
    names = ["l_orderkey", "l_linenumber", *[c for c in whole.columns if c not in ("l_orderkey", "l_linenumber", "file_no")]]
    for number in (0, 3):
        expected = whole.where(F.col("file_no") == number).orderBy(*names).drop("file_no").collect()
        found, = glob.glob(f"{path}/part-{number:05d}-*.csv")
        with open(found, newline="") as f:
            header, *rows = csv.reader(f)
        assert header == [c for c in whole.columns if c != "file_no"]
        assert rows == [["" if v is None else str(v) for v in row] for row in expected]


@pytest.mark.parametrize("text", [feeds.NUMBERED_RIGHT, feeds.NOTES])
def test_rows_are_dealt_before_their_cells_are_spelt_out(spark, lineitem, text):
    plan = feeds.numbered_frame(spark, lineitem, text)._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(" in plan and "concat(" not in plan[plan.index("RepartitionByExpression"):]


def test_report_rows_are_compressed(spark, tmp_path):
    """the rows of a large report are written as gzip, and read back they are those of the plain one."""
    result = spark.range(2000).select(F.concat(F.lit('C "'), F.col("id"), F.lit('", x')).alias("Key"), F.col("id").cast("decimal(38,6)").alias("Total"))
    summary = result.agg(F.count("*").alias("n"))
    sinks.write_result(result, f"{tmp_path}/plain", summary)
    sinks.write_result(result, f"{tmp_path}/small", summary, compression="gzip")
    plain, small = glob.glob(f"{tmp_path}/plain/rows/part-*"), glob.glob(f"{tmp_path}/small/rows/part-*")
    assert all(p.endswith(".csv") for p in plain) and small and all(p.endswith(".csv.gz") for p in small)
    assert sum(map(os.path.getsize, small)) < sum(map(os.path.getsize, plain)) / 3
    assert all(p.endswith(".csv") for p in glob.glob(f"{tmp_path}/small/summary/part-*"))
    one, other = (sources.scan_csv(spark, f"{tmp_path}/{n}/rows") for n in ("plain", "small"))
    assert one.count() == 2000 and one.drop("_file").exceptAll(other.drop("_file")).isEmpty()


def test_written_reports_leave_no_shuffle_setting(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(key, None), []
    with staging.shuffles_dropped(spark):
        seen.append(spark.conf.get(key))
    assert seen == ["true"] and spark.conf.get(key, None) == before
    sinks.write_log(spark.createDataFrame([("WARN", "m", 1)], "level string, message string, occurrences long"), f"{tmp_path}/log")
    assert spark.conf.get(key, None) == before

from decimal import Decimal

from pyspark.sql import functions as F

from twinledger import Options
from twinledger.operators import ordinals
from twinledger.operators import positional_diff as pd


def numbered(df):
    return df.withColumn("_row", F.monotonically_increasing_id() + 1)


def one(table, name, *values):
    return numbered(table([name], *[(v,) for v in values]).coalesce(1))


def test_numeric_tolerance(table):
    assert pd.positional_differences(one(table, "Value", "1.00"), one(table, "Value", "1.005")).count() == 0
    assert pd.positional_differences(one(table, "Value", "1.00"), one(table, "Value", "1.02")).count() == 1
    name = "CustomerPerDayUnitPrice"
    assert pd.positional_differences(one(table, name, "1.00"), one(table, name, "1.05")).count() == 0


def test_date_tolerance(table):
    left, right = one(table, "Date", "2024-01-01"), one(table, "Date", "1/2/2024")
    assert pd.positional_differences(left, right, Options(date_tolerance_days=1)).count() == 0
    row = pd.positional_differences(left, right).first()
    assert row["Explanation"] == "Date mismatch in Date: 1/1/2024 vs 1/2/2024"
    assert row["Suggested Action"] == "Review and confirm correct invoice date."


def test_blanks_and_text(table):
    assert pd.positional_differences(one(table, "Col", ""), one(table, "col", " ")).count() == 0
    assert pd.positional_differences(one(table, "Col", "abc"), one(table, "Col", "ABC ")).count() == 0
    row = pd.positional_differences(one(table, "SkuId", "a"), one(table, "SkuId", "b")).first()
    assert row["Explanation"] == "Text mismatch in Product Code: 'a' vs 'b'"
    assert row["Group"] == "Product Code mismatches"
    close = Options(text_distance=2)
    assert pd.positional_differences(one(table, "Col", "abcd"), one(table, "Col", "abxy"), close).count() == 0


def test_groups_order_and_summary(table):
    options = Options(numeric_tolerance=Decimal(0))
    left = numbered(table("B,A", ("1", "1"), ("1", "1")).coalesce(1))
    right = numbered(table("A,B,C", ("2", "2", "x"), ("2", "2", "x"), ("3", "3", "x")).coalesce(1))
    diffs = pd.positional_differences(left, right, options)
    ordered = [(r["Row Number"], r["Column"]) for r in pd.order_differences(diffs).collect()]
    assert ordered == [(1, "A"), (1, "B"), (2, "A"), (2, "B"), (3, "")]
    assert {r["Group"]: r["n"] for r in pd.group_counts(diffs).collect()} == {"Other mismatches": 4, "Missing Rows": 1}
    summary = pd.summarise_positional(left, right, diffs).first()
    assert tuple(summary) == (3, 5, "Summary: 1 Missing Rows, 4 Other mismatches")
    gone = diffs.where("`Row Number` = 3").first()
    assert gone["Explanation"] == "Row missing in left table"
    back = pd.positional_differences(right, left, options).where("`Row Number` = 3").first()
    assert back["Explanation"] == "Row missing in right table"


def test_numeric_explanation(table):
    row = pd.positional_differences(one(table, "Amount", "10"), one(table, "Amount", "11.239")).first()
    assert (row["Explanation"], row["Our Value"], row["Microsoft Value"]) == (
        "Numeric mismatch in Amount: 10 vs 11.24", "10", "11.24")


def test_bucketed_ordinals(spark):
    df = spark.range(0, 5000).repartition(7).where("id % 3 <> 0")
    rows = ordinals.bucketed_ordinals(df, ["id"], F.floor(F.col("id") / 100)).collect()
    expected = {v: i + 1 for i, v in enumerate(v for v in range(5000) if v % 3)}
    assert {r["id"]: r["_row"] for r in rows} == expected


def test_numbers_follow_the_data_and_keep_nulls(spark):
    rows = [(None, 2), (None, 1), (5, 0), (7, 0), (7, 1)] + [(100 + i * i, 0) for i in range(200)]
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, "a long, b int").withColumn("a", F.col("a").cast(kind)).repartition(5)
        found = sorted((r["n"], r["a"], r["b"]) for r in ordinals.running_number(df, ["a", "b"], "n").collect())
        expected = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0 if kind == "long" else r[0] or "", r[1]))
        assert found == [(i + 1, *r) for i, r in enumerate(expected)]
    one = spark.createDataFrame([(None, 1)], "a long, b int")
    assert [r["n"] for r in ordinals.running_number(one, ["a", "b"], "n").collect()] == [1]
    assert ordinals.running_number(one.limit(0), ["a", "b"], "n").count() == 0

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinledger import Options, fixed_values as fixed
from twinledger.operators import data_quality as dq
from twinledger.operators import findings as fi
from twinledger.operators import invoice_rules as ir
from twinledger.operators.schema import MissingColumns, require_columns

I = ("ChargeStartDate,ChargeEndDate,MSRPPrice,EffectiveDays,PartnerDiscountPercentage,CustomerDiscountPercentage,"
     "Total,CustomerSubtotal")
GOOD = ("2024-01-01", "2024-01-30", "4", "30", "19", "5", "10", "10")


def changed(**cells):
    names = I.split(",")
    row = list(GOOD)
    for k, v in cells.items():
        row[names.index(k)] = v
    return tuple(row)


@pytest.mark.parametrize("row,broken", [
    (GOOD, []),
    (changed(EffectiveDays="10"), ["days"]),
    (changed(EffectiveDays="30.0"), ["days"]),
    (changed(MSRPPrice="6", PartnerDiscountPercentage="5"), ["partner_discount"]),
    (changed(MSRPPrice="6", PartnerDiscountPercentage="0", CustomerDiscountPercentage="0"), ["partner_discount"]),
    (changed(MSRPPrice="6", PartnerDiscountPercentage="20.05"), []),
    (changed(MSRPPrice="6", PartnerDiscountPercentage="20.2"), ["partner_discount"]),
    (changed(MSRPPrice="6", PartnerDiscountPercentage="17.95"), []),
    (changed(Total="15"), ["pricing"]),
    (("2024-01-01", "2024-01-31", "6", "10", "5", "20", "15", "10"), ["days", "partner_discount", "hierarchy", "pricing"]),
    (changed(PartnerDiscountPercentage="10", CustomerDiscountPercentage="100", CustomerSubtotal="0"), []),
    (changed(PartnerDiscountPercentage="10", CustomerDiscountPercentage="100", Total="5", CustomerSubtotal="0"), []),
    (("2024-01-01", "2024-01-30", "4", "30", "10", "20", "10", "5"), ["hierarchy", "pricing"]),
])
def test_invoice_rules(table, row, broken):
    df = table(I, row)
    rows = ir.invalid_rows(df).collect()
    names = [r for r, c in fixed.INVOICE_CHECKS.items() if rows and rows[0][c] is not None]
    assert names == broken and len(rows) == bool(broken)
    counts = ir.severity_counts(df).first()
    high = sum(ir.SEVERITY[r] == "High" for r in broken)
    assert (counts["high"], counts["low"]) == (high, len(broken) - high)
    assert counts["summary"] == f"High: {high}  Low: {len(broken) - high}"


def test_invoice_messages(table):
    row = ir.invalid_rows(table(I, ("2024-01-01", "2024-01-31", "6", "10", "5", "20", "15", "10"))).first()
    assert row["Eff. Days Validation"] == "Mismatch: Expected EffectiveDays is 31 days, but found 10 days."
    assert row["Partner Discount Validation"] == (
        "Invalid: PartnerDiscountPercentage (5%) is not between 18% and 20.1%.")
    assert row["Discount Hierarchy Check"] == (
        "Invalid: PartnerDiscountPercentage (5%) is less than CustomerDiscountPercentage (20%).")
    assert row["Pricing Consistency Check"] == "Invalid: PartnerTotal (15) is greater than CustomerSubTotal (10)."


def test_invoice_edge_inputs(table):
    assert ir.invalid_rows(table("ChargeStartDate,ChargeEndDate", ("2024-01-01", "2024-01-02"))).count() == 1
    assert ir.invalid_rows(table(I)).count() == 0
    old = table("ValidFrom,ValidTo,EffectiveDays", ("2024-01-01", "1/2/2024", "2"))
    assert ir.invalid_rows(old).count() == 0


def test_skipped_checks_warn(table):
    df = table(I, changed(CustomerDiscountPercentage="100", CustomerSubtotal="0"), GOOD)
    rows = ir.skip_findings(df.withColumn("_row", F.lit(3))).collect()
    assert [(r["rule"], r["row"], r["raw_value"]) for r in rows] == [("I3w", 3, "100"), ("I4w", 3, "0")]


def test_high_only(table):
    invalid = ir.invalid_rows(table(I, changed(EffectiveDays="1"), changed(Total="15")))
    assert ir.high_priority_only(invalid).count() == 1 and invalid.count() == 2


def test_zero_field_warns(table):
    rows = dq.row_findings(table("Quantity,PartnerDiscountPercentage", ("5", "0")).withColumn("_row", F.lit(1))).collect()
    assert any(r["column"] == "PartnerDiscountPercentage" and r["row"] == 1 for r in rows)
    assert any(r["description"] == "Value is 0 or blank while Quantity is 5" for r in rows)
    assert any(r["rule"] == "Q3" for r in rows)


def test_row_rules(table):
    df = table("Quantity,PartnerDiscountPercentage,OrderDate,PartnerTotal,CustomerName,SkuId",
               ("1", "95", "soon", "-5", " ", ""))
    found = {(r["rule"], r["column"]) for r in dq.row_findings(df).collect()}
    assert found == {("Q2b", "PartnerDiscountPercentage"), ("Q4", "OrderDate"), ("Q5", "PartnerTotal")}
    contexts = {r["context"] for r in dq.row_findings(df).collect()}
    assert contexts == {"Customer: (missing), SKU: (missing)"}


def test_blank_rate_threshold(table):
    df = table("CustomerSubTotal,Quantity", *[("0" if i < 2 else "1", "1") for i in range(10)])
    rows = dq.blank_rate_findings(df, "f.csv").collect()
    assert [(r["column"], r["row"], r["description"]) for r in rows] == [
        ("CustomerSubTotal", -1, "More than 20% of rows have zero or blank values in column CustomerSubTotal")]
    exactly = table("CustomerSubTotal", *[("0" if i < 1 else "1",) for i in range(10)])
    assert dq.blank_rate_findings(exactly).count() == 0


def test_quality_summary(table):
    df = table("Quantity,PartnerDiscountPercentage,CustomerSubTotal", ("1", "200", ""), ("1", "50", "10"))
    summary = dq.quality_summary(df, dq.quality_findings(df, "file.csv")).first()
    assert summary["total_rows"] == 2 and summary["errors"] == 1
    assert summary["blank_columns"] == "CustomerSubTotal: 1/2"
    assert summary["summary"].startswith("Total rows: 2\nErrors: 1\nWarnings: 1\nMost common error: Discount percentage")
    empty = table("Quantity", )
    assert dq.quality_summary(empty, dq.quality_findings(empty)).first()["top_error"] == "None"


def issues(spark, n, description="Issue"):
    rows = [("Error", "T", i + 1, "Col", description, "bad", "f.csv", "ctx", False) for i in range(n)]
    return spark.createDataFrame(rows, fi.FINDING_TYPE)


def test_cap_per_group(spark):
    rows = fi.cap_per_group(issues(spark, 5), Options(max_detailed_rows=2)).collect()
    assert len(rows) == 3
    last = [r for r in rows if r["is_summary"]]
    assert len(last) == 1 and last[0]["row"] == -1
    assert last[0]["description"] == "3 additional rows had the same error: Issue"
    assert sorted(r["row"] for r in rows if not r["is_summary"]) == [1, 2]
    assert fi.cap_per_group(issues(spark, 2), Options(max_detailed_rows=2)).count() == 2


def test_cap_evaluates_findings_once(spark):
    plan = fi.cap_per_group(issues(spark, 5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Window" not in plan and "Join" not in plan and "Union" not in plan


def test_cap_of_many_parts(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice(["Error", "Warning"]), rng.choice("TU"), rng.randrange(-1, 40), rng.choice(["A", "B"]), f"d{min(rng.randrange(40), 12)}",
             rng.choice(["", "x", "é"]), rng.choice(["f", "g"]), "", False) for _ in range(900)]
    for limit in (1, 5):
        groups = {}
        for r in rows:
            groups.setdefault((r[0], r[3], r[4]), []).append(r)
        want = []
        for (level, column, description), found in groups.items():
            found = sorted(found, key=lambda r: (r[2], r[5], r[6], r[7], r[1]))
            want += [(r[0], r[2], r[3], r[4], r[5], r[6], False) for r in found[:limit]]
            if len(found) > limit:
                text = f"{len(found) - limit} additional rows had the same error: {description}"
                want.append((level, -1, column, text, "", min(r[6] for r in found), True))
        capped = fi.cap_per_group(spark.createDataFrame(rows, fi.FINDING_TYPE).repartition(7), Options(max_detailed_rows=limit))
        got = [(r["level"], r["row"], r["column"], r["description"], r["raw_value"], r["file_name"], r["is_summary"]) for r in capped.collect()]
        assert sorted(got) == sorted(want)
    # A partition that holds few rows passes groups on several times; the counts stay.
    monkeypatch.setattr(fi, "_HELD", 20)
    frame = pd.DataFrame(rows, columns=fi.FINDING_TYPE.names)
    parts = pd.concat(fi._least_rows(5)(frame[i:i + 15] for i in range(0, 900, 15)))
    assert len(parts) > 60 and parts["_n"].sum() == 900


def test_summary_of_a_feed_in_one_pass(table):
    rng = random.Random(2)
    cell = lambda: rng.choice(["", "0", "1", "50", "200", "-5", "x", "soon", " "])
    df = table("Quantity,PartnerDiscountPercentage,CustomerSubTotal,OrderDate,PartnerTotal", *[[cell() for _ in range(5)] for _ in range(80)])
    for feed in (df, df.limit(0)):
        assert dq.feed_summary(feed).first() == dq.quality_summary(feed, dq.quality_findings(feed)).first()
    assert dq.feed_summary(df.select("OrderDate")).first()["total_rows"] == 80
    plan = dq.feed_summary(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "Union" not in plan


def test_counts_and_levels(spark):
    found = issues(spark, 2, "sample")
    assert [tuple(r) for r in fi.counts_by_description(found).collect()] == [("Error", "sample", 2)]
    assert fi.has_level(found, "Error") and not fi.has_level(found, "Warning")
    top = dq.most_common_error(found.unionByName(issues(spark, 2, "a")).unionByName(issues(spark, 1, "0"))).first()
    assert tuple(top) == ("a", 2)


def test_required_columns(spark, table):
    with pytest.raises(MissingColumns) as error:
        require_columns(table("a"), "feed", ["A", "B"])
    assert str(error.value) == "feed is missing required columns: B"
    row = error.value.findings(spark).first()
    assert row["column"] == "B" and row["description"].startswith("The expected column 'B' was not found in the feed file.")

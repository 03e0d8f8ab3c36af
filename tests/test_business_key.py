import random
from collections import Counter
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from twinledger import Options
from twinledger.functions import numbers as num
from twinledger.operators import business_key as bk
from twinledger.plans.runs import compare

K = "CustomerDomainName,ProductId,UnitPrice,Subtotal,Total,Quantity"


def line(domain="cust.com", product="P1", total="10", more=()):
    return (domain, product, "1", "1", total, "1", *more)


def run(left, right, options=Options()):
    keys = bk.compare_keys(left, right, options)
    rows = bk.result_rows(keys, options).collect()
    return rows, bk.summarise(keys, options).first()["summary"]


def summary(matched=0, right=0, left=0, mismatched=0, errors=0, total=1, reported=1, skipped=0, duplicates=0):
    return (
        f"Matched: {matched} | Missing in Microsoft: {right} | Missing in MSPHub: {left} | Mismatched: {mismatched}"
        f" | Data Errors: {errors} | Total unique MSPHub keys: {total}; Reported: {reported}; Skipped: {skipped};"
        f" Duplicates: {duplicates}"
    )


def test_missing_right(table):
    rows, _ = run(table(K, line()), table(K))
    assert [r["Status"] for r in rows] == ["Missing in Microsoft"]


@pytest.mark.parametrize("total,status,details", [
    ("12", "Mismatched", "Total:-2"), ("10", "Matched", ""), ("11", "Mismatched", "Total:-1"),
    ("10.01", "Matched", ""), ("10.011", "Mismatched", "Total:-0.01"), ("(10)", "Mismatched", "Total:+20"),
])
def test_totals(table, total, status, details):
    rows, _ = run(table(K, line()), table(K, line(total=total)))
    assert [(r["Status"], r["MismatchDetails"]) for r in rows] == [(status, details)]


def test_dates_ignored_and_fallback_column(table):
    left = table("CustomerDomainName,ProductId,ChargeStartDate,PartnerTotal", ("cust.com", "P1", "2024-01-01", "10"))
    right = table("CustomerDomainName,ProductId,ChargeStartDate,Total", ("cust.com", "P1", "2024-02-02", "10"))
    assert run(left, right)[0][0]["Status"] == "Matched"


def test_fallback_only_for_blank_cells(table):
    left = table("CustomerDomainName,ProductId,Total,PartnerTotal", ("c", "1", "x", "10"), ("c", "2", " ", "10"))
    rows = {r["ProductId"]: r["HubTotal"] for r in run(left, table(K))[0]}
    assert rows == {"1": 0, "2": 10}


def test_partner_slice_needs_one_shared_partner(table):
    with_partner = K + ",PartnerId"
    left = table(with_partner, line(more=("T1",)))
    rows, text = run(left, table(with_partner, line(more=("T1",)), line(more=("T2",))))
    assert [r["Status"] for r in rows] == ["Mismatched"]
    assert text == summary(mismatched=1)
    rows, _ = run(left, table(with_partner, line(more=("t1",)), line(more=(" ",))))
    assert [r["Status"] for r in rows] == ["Matched"]


def test_partner_mismatch_is_logged(table):
    with_partner = K + ",PartnerId"
    left, right = table(with_partner, line(more=("T1",))), table(with_partner, line(more=("T2",)))
    log = compare(left, right).log.where("message LIKE 'PartnerId mismatch%'")
    assert log.count() == 1
    assert compare(left, left).log.where("message LIKE 'PartnerId mismatch%'").count() == 0


def test_unit_price_fallback_is_reported_not_compared(table):
    left = table("CustomerDomainName,ProductId,PartnerUnitPrice", ("foo.com", "P1", "10"))
    right = table("CustomerDomainName,ProductId,UnitPrice", ("foo.com", "P1", "10"))
    rows, text = run(left, right)
    assert rows[0]["Status"] == "Matched" and text == summary(matched=1)
    assert rows[0]["HubUnitPrice"] == 0  # no quantity


def test_case_insensitive_keys(table):
    rows, text = run(table(K, line("foo.com")), table(K, line(" FOO.COM ")))
    assert rows[0]["Status"] == "Matched" and text == summary(matched=1)


def test_duplicates_are_summed(table):
    rows, text = run(table(K, line("dup.com"), line("dup.com")), table(K, line("dup.com"), line("dup.com")))
    assert [r["Status"] for r in rows] == ["Matched"] and text == summary(matched=1, duplicates=1)


def test_right_only_reported_and_hidden(table):
    left, right = table(K, line()), table(K, line(), line(product="P2"))
    rows, text = run(left, right)
    assert sorted(r["Status"] for r in rows) == ["Matched", "Missing in MSPHub"]
    assert text == summary(matched=1, left=1)
    rows, text = run(left, right, Options(hide_right_only=True))
    assert [r["Status"] for r in rows] == ["Matched"] and text == summary(matched=1)


def test_blank_key_is_a_data_error_even_if_on_both_sides(table):
    rows, text = run(table(K, line(product=" ")), table(K, line(product="")))
    assert [(r["Status"], r["HubTotal"], r["MSTotal"]) for r in rows] == [("Data Error", 10, 0)]
    assert text == summary(errors=1, total=0, reported=0)


def test_excluded_tenants_come_back_as_zero_errors(table):
    options = Options(excluded_tenants=("Demo",))
    left, right = table(K, line("demo "), line()), table(K, line("DEMO"), line("demo", "P9"), line())
    rows, text = run(left, right, options)
    assert sorted((r["CustomerDomainName"], r["Status"], r["HubTotal"]) for r in rows) == [
        ("CUST.COM", "Matched", 10), ("DEMO", "Data Error", 0)]
    assert text == summary(matched=1, errors=1, total=2, reported=1, skipped=1)
    rows, _ = run(left, right, replace(options, drop_excluded=True))
    assert [r["Status"] for r in rows] == ["Matched"]
    keys = bk.compare_keys(left, right, options)
    assert [tuple(r) for r in bk.key_diagnostics(keys).collect()] == [("DEMO", "P1", "Skipped")]
    tenant = bk.run_log(keys, options).where("message = 'Excluded tenant DEMO'").first()
    assert tenant["occurrences"] == 3


def test_duplicate_levels(table):
    left = table(K, *[line("a")] * 6, *[line("b")] * 2, line("c"))
    keys = bk.compare_keys(left, table(K, line("a")))
    assert {(r["CustomerDomainName"], r["n"], r["level"]) for r in bk.duplicate_keys(keys).collect()} == {
        ("A", 6, "ERROR"), ("B", 2, "WARN")}
    log = {(r["level"], r["message"]) for r in bk.run_log(keys).collect()}
    assert ("ERROR", "Duplicate A|P1 appears 6 times") in log
    assert ("WARN", "Key missing in Microsoft: B|P1") in log
    assert ("INFO", "Key matched: A|P1") in log


def test_weighted_unit_price(table):
    left = table(K, ("c", "p", "2", "0", "0", "1"), ("c", "p", "4", "0", "0", "3"))
    assert run(left, table(K))[0][0]["HubUnitPrice"] == 3.5


def random_feed(rng, table, n):
    rows = [
        line(rng.choice(["hot.com"] * 5 + ["a.com", "B.com ", "c.com", ""]), rng.choice(["P1", "p1", "P2", "P3", " "]),
             str(rng.randint(1, 3)))
        for _ in range(n)
    ]
    return rows, table(K, *rows)


def test_against_brute_force_and_partitioning(table):
    rng = random.Random(3)
    (lrows, left), (rrows, right) = random_feed(rng, table, 60), random_feed(rng, table, 60)

    def totals(rows):
        sums = {}
        for r in rows:
            key = (r[0].strip().upper(), r[1].strip().upper())
            q, t = sums.get(key, (0, 0))
            sums[key] = (q + 1, t + int(r[4]))
        return sums
    l, r = totals(lrows), totals(rrows)
    expected = {}
    for key in l.keys() | r.keys():
        if key in l and "" in key:
            expected[key] = "Data Error"
        elif key not in r:
            expected[key] = "Missing in Microsoft"
        elif key not in l:
            expected[key] = "Missing in MSPHub"
        else:
            expected[key] = "Matched" if l[key] == r[key] else "Mismatched"
    for parts in (1, 7):
        shuffled = left.orderBy(F.rand(parts)).repartition(parts)
        rows, _ = run(shuffled, right.repartition(parts))
        assert {(x["CustomerDomainName"], x["ProductId"]): x["Status"] for x in rows} == expected
        assert len(rows) == len(expected)


def test_swapping_sides_swaps_missing(table):
    left = table(K, line("a"), line("b"), line("c", total="5"))
    right = table(K, line("b"), line("c"), line("d"))
    there = Counter(r["Status"] for r in run(left, right)[0])
    back = Counter(r["Status"] for r in run(right, left)[0])
    assert there["Missing in Microsoft"] == back["Missing in MSPHub"] == 1
    assert there["Missing in MSPHub"] == back["Missing in Microsoft"] == 1
    assert there["Matched"] == back["Matched"] and there["Mismatched"] == back["Mismatched"]


def test_two_pass_run(table):
    left = table("CustomerDomainName,ProductId,ChargeType,Quantity,Subtotal,Total", ("c", "p", "Usage", "1", "1", "1"))
    right = table("CustomerDomainName,ProductId,ChargeType,Quantity,Subtotal,Total", ("c", "p", "Usage", "1", "3", "3"))
    result = compare(left, right)
    assert result.result.first()["MismatchDetails"] == "Subtotal:-2; Total:-2"
    assert result.price_mismatches.first()["PriceDiff"] == -2
    assert result.price_mismatches.first()["ChargeType"] == "USAGE"
    assert "Mismatched: 1" in result.summary.first()["summary"]
    bill = bk.over_under_bill(result.keys).first()
    assert (bill["total_rows"], bill["unmatched_groups"], bill["over_bill"], bill["under_bill"]) == (1, 1, 0, 2)


def test_priority(table):
    options = Options(high_priority_threshold=20)
    left = table(K, line("a", total="100"), line("b", total="11"), line("c", total="100"))
    rows, _ = run(left, table(K, line("a"), line("b"), line("c", total="100")), options)
    assert {r["CustomerDomainName"]: r["Priority"] for r in rows} == {"A": "High", "B": "Low", "C": "Low"}


@pytest.mark.parametrize("a, b", [
    ("1000000000000", "2000000000000"), ("1E13", "7E13"), ("7.9E28", "7.8E28"), ("99999999999999999999.01", "99999999999999999999.05"),
])
def test_large_amounts_differ(table, a, b):
    h = "CustomerDomainName,ProductId,Quantity,UnitPrice,Subtotal,TaxTotal,Total"
    left, right = (table(h, ("d", "p", "1", "1", "1", "0", total)) for total in (a, b))
    row = bk.compare_business_keys(left, right).first()
    assert row["Status"] == "Mismatched"
    assert bk.compare_business_keys(left, left).first()["Status"] == "Matched"


def test_large_typed_amounts_differ(spark):
    kind = "CustomerDomainName string, ProductId string, Quantity int, Total decimal(20,2)"
    left, right = (spark.createDataFrame([("d", "p", 1, Decimal(t))], kind) for t in (10**13, 3 * 10**13))
    assert bk.compare_business_keys(left, right).first()["Status"] == "Mismatched"


def test_large_amounts(table):
    h = "CustomerDomainName,ProductId,Quantity,Total"
    big, least = "9E31", "-90000000000000000000000000000000"
    left = table(h, ("a", "1", "1E33", "1"), ("b", "1", "1", big), ("b", "1", "1", big), ("c", "1", "1", big),
                 ("d", "1", "1", big), ("d", "1", "1", big), ("d", "1", "1", least), ("e", "1", "1e15", "0.000001"), ("f", "1", "x" * 40, "1"))
    right = table(h, ("a", "1", "7E33", "1"), ("b", "1", "2", "1"), ("c", "1", "1", least), ("d", "1", "3", big), ("e", "1", "1E15", "0"), ("f", "1", "0", "1"))
    got = {r["CustomerDomainName"]: (r["Status"], r["MismatchDetails"]) for r in bk.compare_business_keys(left, right).collect()}
    assert got == {
        "A": ("Data Error", "Amount out of range"), "B": ("Data Error", "Amount out of range"),
        "C": ("Mismatched", "Total:+180000000000000000000000000000000"), "D": ("Matched", ""), "E": ("Matched", ""), "F": ("Matched", "")}
    assert {r["CustomerDomainName"]: r["has_error"] for r in bk.key_totals(left).collect()} == {
        "A": True, "B": True, "C": False, "D": False, "E": False, "F": False}
    log = bk.run_log(bk.compare_keys(left, right)).where("message LIKE '%out of range'")
    assert {r["message"] for r in log.collect()} == {"Key A|1 has an amount out of range", "Key B|1 has an amount out of range"}


def test_sums_beyond_the_widest_number_are_reported(spark):
    """More of the largest amounts under one key than the upper part of a sum can hold."""
    rows = spark.range(120_000).select(
        F.lit("C").alias("CustomerDomainName"), F.lit("P1").alias("ProductId"), F.lit("9E31").alias("Total"))
    found = bk.compare_business_keys(rows, rows.limit(1)).select("Status", "MismatchDetails").collect()
    assert [tuple(r) for r in found] == [("Data Error", "Amount out of range")]


def test_log_of_held_keys(table):
    """The log reads a written table: no part of it groups the feeds again."""
    keys = bk.compare_keys(table(K, line(), line(), line(product="")), table(K, line(domain="excl.com")), Options(excluded_tenants=("excl.com",)))
    held = bk.run_log(bk.held_keys(keys), Options(excluded_tenants=("excl.com",)))
    assert Counter(map(tuple, held.collect())) == Counter(map(tuple, bk.run_log(keys, Options(excluded_tenants=("excl.com",))).collect()))
    assert "LogicalRDD" not in held._jdf.queryExecution().optimizedPlan().toString()


def test_quantities_are_summed_once(table):
    """A partial row of the grouping holds as few sums as possible: these are what is shuffled."""
    plan = bk.compare_business_keys(table(K, line()), table(K, line()))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_sum(l_Quantity") == 0 and plan.count("try_sum(l_Weighted") > 0


def test_scans_read_small_parts(spark):
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "8m"


def test_typed_amounts_are_summed_in_narrow_rows(spark):
    """Amounts whose types keep them below a trillion have no second sum; the results are those of wider types."""
    most = "999999999999.999999"
    rows = [("a", "p", most, None, 5), ("a", "p", most, "-2.5", 5), ("b", "q", None, "1.25", -7), (None, "q", "3", "0", 1)]
    frames = []
    for kind in ("decimal(18,6)", "decimal(30,6)"):
        feed = spark.createDataFrame(rows, "CustomerDomainName string, ProductId string, t string, s string, Quantity int")
        frames.append(feed.selectExpr(
            "CustomerDomainName", "ProductId", f"CAST(t AS {kind}) AS Total", f"CAST(s AS {kind}) AS Subtotal",
            "CAST(0.5 AS DECIMAL(2,1)) AS TaxTotal", "Quantity", "CAST(2 AS DECIMAL(18,6)) AS UnitPrice"))
    narrow, wide = [bk.group_totals(bk.prepare_side(f), bk.prepare_side(f.where("Quantity = 5"))) for f in frames]
    assert sorted(narrow.collect(), key=repr) == sorted(wide.collect(), key=repr)

    def sums(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("sum(")

    assert sums(narrow) < sums(wide)
    assert num.is_below_limb(frames[0], "Total", "Quantity") and not num.is_below_limb(frames[1], "Total")
    assert not num.is_below_limb(frames[0], "Quantity", "ProductId")

import csv
import glob
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from twinledger import Options, fixed_values as fixed
from twinledger.operators import data_quality as dq
from twinledger.operators import positional_diff as pdiff
from twinledger.operators import schema as sc
from twinledger.plans import imports
from twinledger.plans.runs import compare, validate
from twinledger.sources import feeds, sinks


def write(path, header, *rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([header.split(","), *rows])
    return str(path)


def test_scan_normalise_and_findings(spark, tmp_path):
    path = write(tmp_path / "sample.csv", "Id,Quantity,Date,Name", ("001", " 2 ", "01/02/2024", "Widget"),
                 ("002", "abc", "2024-05-01", "Tool"), ("003", "", "05/05/2024", "Gizmo"))
    raw = feeds.scan_csv(spark, path)
    rows = imports.normalise(raw).orderBy("_row").collect()
    assert [(r["Id"], r["Quantity"], r["Date"], r["_row"], r["_file"]) for r in rows] == [
        ("001", "2", "2024-01-02", 1, "sample.csv"), ("002", "abc", "2024-05-01", 2, "sample.csv"),
        ("003", "", "2024-05-05", 3, "sample.csv")]
    found = imports.normalise_findings(raw).collect()
    assert [(r["row"], r["column"], r["file_name"]) for r in found] == [(2, "Quantity", "sample.csv")]
    assert found[0]["description"] == "Invalid numeric 'abc' – unable to parse."


def test_ragged_quoted_and_repeated(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text('A , B,C\n1,"x, ""y""",3,surplus\n2,z\n')
    rows = feeds.scan_csv(spark, str(path)).orderBy("_row").collect()
    assert [(r["A"], r["B"], r["C"]) for r in rows] == [("1", 'x, "y"', "3"), ("2", "z", "")]
    again = tmp_path / "again.csv"
    again.write_text("A,a \n1,2\n")
    with pytest.raises(ValueError, match="Repeated column names"):
        feeds.scan_csv(spark, str(again))


def test_file_ordinals_over_many_splits(spark, tmp_path):
    sizes = {"one.csv": 900, "two.csv": 1, "three.csv": 700}
    for name, n in sizes.items():
        write(tmp_path / name, "v,pad", *[(str(i), "x" * (i % 50)) for i in range(1, n + 1)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scan = feeds.scan_csv(spark, str(tmp_path))
        assert scan.count() == sum(sizes.values())
        assert scan.where("CAST(v AS long) <> _row").count() == 0
        assert scan.where("v = '500'").first()["_row"] == 500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_right_import(spark, tmp_path):
    path = write(
        tmp_path / "G0.csv",
        "CustomerName,CustomerDomainName,ProductId,SkuId,ChargeType,TermAndBillingCycle,BillingFrequency,"
        "SubscriptionDescription",
        *[("A", "a.com", "p1", "1", "Usage", "One-Year commitment for monthly/yearly billing", "Monthly", d)
          for d in ("Azure plan", "Service")])
    feed = imports.import_feed(spark, path)
    rows = feed.rows.collect()
    assert len(rows) == 1 and (rows[0]["Term"], rows[0]["BillingCycle"]) == ("Annual", "Monthly")
    assert feed.rows.columns[:9] == list(fixed.RIGHT_LEADING_COLUMNS)
    assert set(fixed.CANONICAL_COLUMNS) <= set(feed.rows.columns)
    assert imports.row_count(feed.rows).first()["n"] == 1
    assert feed.findings.where("level = 'Error'").count() == 0


LEFT_HEADER = (
    "PartnerId,CustomerId,CustomerName,CustomerDomainName,CustomerCountry,PartnerInvoiceNumber,OrderNumber,OrderDate,"
    "ProductId,PartNumber,SkuName,ProductName,ChargeType,PartnerUnitPrice,Quantity,PartnerSubTotal,PartnerTaxTotal,"
    "PartnerTotal,PricingCurrency,SubscriptionId,Term,BillingCycle,PartnerEffectiveUnitPrice,ExtraColumn")
LEFT_ROW = ("P1,C1,Client,client.com,US,INV1,ORD1,2024-01-01,Prod1,PN-1,Name1,ProdName,Usage,5,2,10,1,11,USD,SUB1,"
            "Monthly,Monthly,4.5,SHOULD_DROP").split(",")


def test_left_import(spark, tmp_path):
    path = write(tmp_path / "ind_1.csv", LEFT_HEADER, LEFT_ROW)
    rows = imports.import_left(spark, path).rows.collect()
    assert len(rows) == 1 and rows[0]["SkuId"] == "PN-1" and rows[0]["InvoiceNumber"] == "INV1"
    assert rows[0]["Total"] == "11" and rows[0]["TermAndBillingCycle"] == "Monthly"
    assert "ExtraColumn" not in rows[0].asDict()
    kept = imports.import_left(spark, path, Options(keep_extras=True)).rows.first()
    assert kept["ExtraColumn"] == "SHOULD_DROP"
    with pytest.raises(sc.MissingColumns, match="ReferenceId"):
        imports.import_feed(spark, path)


OLD_HEADER = ("SkuId,BillingCycle,ResourceName,ValidFrom,ValidTo,PurchaseDate,PartnerTotal,InternalReferenceId,"
              "CustomerName,CustomerDomainName,ProductId,ChargeType")


def test_left_import_with_old_names(spark, tmp_path):
    path = write(
        tmp_path / "IND2.csv", OLD_HEADER,
        "001,Monthly,Azure plan,2024-01-01,2024-01-31,2024-01-01,100,REF1,Client,client.com,prod1,Usage".split(","),
        "002,Monthly,Regular Product,2024-02-01,2024-02-28,2024-02-01,200,REF2,Client,client.com,prod2,Usage".split(","))
    rows = imports.import_feed(spark, path).rows.collect()
    assert [(r["SkuId"], r["ProductName"], r["ChargeStartDate"], r["Total"]) for r in rows] == [
        ("2", "Regular Product", "2024-02-01", "200")]
    assert rows[0]["BillingFrequency"] == "Monthly"
    named = write(tmp_path / "IND3.csv", OLD_HEADER.replace("SkuId", "SkuName"),
                  "SKU_1,Monthly,Regular,2024-02-01,2024-02-28,2024-02-01,200,REF2,Client,client.com,p,Usage".split(","))
    assert imports.import_feed(spark, named).rows.first()["SkuId"] == "SKU_1"


def test_distributor_import(spark, tmp_path):
    path = write(tmp_path / "BillingTransactions_1.csv", "CustomerDomainName,ProductId,Sku,CustomerUnitPrice,Quantity,CustomerTax",
                 ("c.com", "p", "0S", "2.50", "3", "1.25"), ("c.com", "p", "S", "", "3", "5"), ("", "", "S", "1", "1", "1"))
    feed = imports.import_feed(spark, path, check=False)
    rows = feed.rows.orderBy("_row").collect()
    assert [(r["Subtotal"], r["Total"], r["TaxTotal"], r["SkuId"]) for r in rows] == [
        ("7.5", "8.75", "1.25", "S"), ("0", "5", "5", "S")]
    assert [r["_row"] for r in feed.rejects.collect()] == [3]


def test_map_rules(table):
    maps = {"X": {"CustomerDomainName": "d", "ProductId": "d", "Subtotal": ("a", "b", "*"), "Total": ("a", "b", "+", "c"),
                  "TaxTotal": "{a} / 0", "SkuId": ("n", "a")}}
    df = table("d,a,b,c,n", ("k", "2", "3", "x", ""), ("k", "1,5", "2", "1", " "))
    rows = sc.map_canonical(df, "X", Options(column_maps=maps)).collect()
    assert [(r["Subtotal"], r["Total"], r["TaxTotal"], r["SkuId"], r["Currency"]) for r in rows] == [
        ("6", "6", "0", "2", ""), ("30", "31", "0", " ", "")]


def test_key_fallback_and_reject(table):
    raw = table("CustomerDomainName,CustomerName,ProductId,PartNumber", (" ", "Client", "", "pn"), ("", "", "p", "pn"))
    rows, rejects = imports.canonical_right(raw)
    assert [(r["CustomerDomainName"], r["ProductId"]) for r in rows.collect()] == [("CLIENT", "PN")]
    assert rejects.count() == 1


def test_out_of_range_amount_is_reported(table):
    rows = imports.normalise_findings(table("Total", ("123456789012345678901234567890123",), ("1E33",), ("999999999999",), ("1E13",))).collect()
    assert [r["description"] for r in rows] == [
        "Number '123456789012345678901234567890123' is out of range.", "Number '1E33' is out of range."]


def test_sources(spark, tmp_path):
    assert feeds.detect_source("/x/g0123.csv") == fixed.MICROSOFT
    assert feeds.detect_source("INDabc.csv") == fixed.PARTNER
    with pytest.raises(feeds.UnknownSource):
        feeds.detect_source("other.csv")
    write(tmp_path / "g01.csv", "A", ("1",))
    write(tmp_path / "G02.csv", "A", ("2",))
    write(tmp_path / "ind.csv", "B", ("3",))
    write(tmp_path / "what.csv", "C", ("4",))
    kinds = {r["file_name"]: r["source_type"] for r in feeds.folder_kinds(spark, str(tmp_path)).collect()}
    assert kinds == {"g01.csv": "Microsoft", "G02.csv": "Microsoft", "ind.csv": "Partner", "what.csv": None}
    scan = feeds.scan_kind(spark, str(tmp_path), fixed.MICROSOFT)
    assert sorted((r["A"], r["_row"]) for r in scan.collect()) == [("1", 1), ("2", 1)]
    empty = write(tmp_path / "G0empty.csv", "A")
    with pytest.raises(ValueError, match="contains no rows"):
        imports.import_feed(spark, empty)


def test_aliases_keep_types(spark):
    df = spark.createDataFrame([(None, 5, "a")], "Quantity int, BillableQuantity int, MPNId string")
    row = sc.prepare_side(df).first()
    assert row["Quantity"] == 5 and row["ProductId"] == "A" and row["ChargeType"] == ""


def test_hide_columns_and_reorder(table):
    df = table("a,UnitType,b")
    assert sc.hide_columns(df).columns == ["a", "b"]
    assert sc.reorder(df, ["B", "zz"]).columns == ["b", "a", "UnitType"]


def read(folder):
    lines = []
    for part in sorted(glob.glob(os.path.join(folder, "part-*"))):
        with open(part, newline="") as f:
            lines += list(csv.reader(f))
    return lines


def test_sinks(spark, table, tmp_path):
    found = dq.row_findings(table("Quantity,SkuId,PartnerTotal", ("1", "s", "-5.129")).withColumn("_row", F.lit(7)), 'f"1,2.csv')
    sinks.write_findings(found, str(tmp_path / "findings"))
    header, row, *_ = read(tmp_path / "findings")
    assert header == ["Timestamp", "ErrorLevel", "RowNumber", "ColumnName", "Description", "RawValue", "FileName", "Context"]
    rows = {tuple(r[1:7]) for r in read(tmp_path / "findings")}
    assert ("Warning", "7", "Total", "Negative total value", "-5.13", 'f"1,2.csv') in rows
    left, right = table("A,_row", ("1", "1")), table("A,_row", ("2", "1"))
    diffs = pdiff.positional_differences(left, right)
    sinks.write_differences(diffs, pdiff.summarise_positional(left, right, diffs), str(tmp_path / "diff"))
    assert ["1", "A", "1", "2", "Numeric mismatch in A: 1 vs 2", ""] in read(tmp_path / "diff" / "differences")
    assert read(tmp_path / "diff" / "summary")[1] == ["1", "1", "Summary: 1 Other mismatches"]
    run = compare(table("CustomerDomainName,ProductId,Total", ("c", "p", "1"), ("c", "p", "1")),
                  table("CustomerDomainName,ProductId,Total", ("c", "p", "1")))
    sinks.write_log(run.log, str(tmp_path / "log"))
    sinks.write_key_diagnostics(run.diagnostics, str(tmp_path / "keys"))
    sinks.write_result(run.result, str(tmp_path / "result"), run.summary)
    assert read(tmp_path / "keys")[1] == ["C", "P", "Duplicate x2"]
    assert ["C", "P", "Mismatched"] == read(tmp_path / "result" / "rows")[1][:3]
    assert any("Duplicate C|P appears 2 times" in r for r in read(tmp_path / "log"))
    invalid = validate(table("ChargeStartDate,ChargeEndDate,Total", ("2024-01-01", "2024-01-01", "5"))).invalid
    sinks.write_invalid_rows(invalid, str(tmp_path / "invalid"))
    assert [r[-1] for r in read(tmp_path / "invalid" / "rows") if r[-1] != "severity"] == ["High"]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_result(run.result, str(tmp_path / "result"))


def test_imported_feeds_compare(spark, tmp_path):
    left = write(tmp_path / "ind_1.csv", LEFT_HEADER, LEFT_ROW)
    right = write(
        tmp_path / "G0.csv", "CustomerDomainName,ProductId,SkuId,ChargeType,TermAndBillingCycle,Quantity,Subtotal,TaxTotal,Total",
        ("Client.com", "prod1", "x", "Usage", "", "2", "10", "1", "11.5"))
    run = compare(imports.import_left(spark, left).rows, imports.import_right(spark, right).rows)
    # The customer name wins over nothing: CustomerDomainName is filled on both sides.
    assert [(r["Status"], r["MismatchDetails"]) for r in run.result.collect()] == [("Mismatched", "Total:-0.5")]


def test_options_from_parts():
    assert replace(Options(), max_detailed_rows=3).max_detailed_rows == 3
    assert Options().missing_left == "Missing in MSPHub"


def test_padded_keys_meet(table):
    h = "InvoiceNumber,SkuId,Quantity"
    right = sc.normalise_mapped(table(h, ("0012", "001", "1"), ("inv7", "a1", "2"), ("(5)", "1,000", "3")))
    left = sc.normalise_mapped(table(h, ("12", "1", "1"), ("INV7", "A1", "2"), ("-5", "1000", "3")))
    assert right.exceptAll(left).count() == 0 == left.exceptAll(right).count()


def _plans(*frames):
    return [f._jdf.queryExecution().executedPlan().toString() for f in frames]


def test_import_in_one_pass(spark, tmp_path):
    """Side outputs of one scan: the same rows, findings and rejects as evaluated apart."""
    header = "CustomerDomainName,ProductId,SkuId,ChargeType,TermAndBillingCycle,SubscriptionDescription,Quantity,ChargeStartDate,TaxTotal"
    rows = [(f"c{i}.com" if i % 7 else "", f"p{i}", "s", 'a "quoted", cell' if i % 5 else "two\nlines", "", "Azure plan" if i % 11 == 0 else "x",
             "many" if i % 3 == 0 else str(i), "soon" if i % 4 == 0 else "2024-01-02", str(5 - i)) for i in range(120)]
    path = write(tmp_path / "G0_1.csv", header, *rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        feed = imports.import_feed(spark, path)
        apart = imports.import_frame(feeds.scan_csv(spark, path), fixed.MICROSOFT, file_name="G0_1.csv")
        key = lambda r: repr(sorted(r.asDict().items()))
        for one, other in zip((feed.rows, feed.findings, feed.rejects), (apart.rows, apart.findings, apart.rejects)):
            found = sorted(one.collect(), key=key)
            assert found and sorted(one.columns) == sorted(other.columns)
            assert [sorted(r.asDict().items()) for r in found] == [sorted(r.asDict().items()) for r in sorted(other.collect(), key=key)]
        shown = feed.rows.drop("_row")
        assert all("FileScan csv" not in p and "FileScan text" not in p for p in _plans(feed.rows, feed.findings, feed.rejects))
        assert "Exchange" not in _plans(shown)[0] and "Join" not in _plans(shown)[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["row"] for r in feed.findings.where("column = 'Quantity' AND rule = 'Q7'").collect()} == {i + 1 for i in range(120) if i % 3 == 0}
    assert {r["_row"] for r in feed.rejects.collect()} == {i + 1 for i in range(120) if i % 7 == 0}


def test_legacy_file(spark, tmp_path):
    path = write(tmp_path / "old.csv", " InvoiceNumber ,ChargeType,Quantity,PartnerUnitPrice,UnitPrice,OrderDate,Note",
                 (" inv1 ", "usage", "2", "1.5", "9", "2024-03-05", "a\nb"), ("inv2", "Seat", "", "", "9", "soon", ""))
    rows = imports.import_legacy(spark, path)
    assert not {c.lower() for c in rows.columns} & {"partnerunitprice", "_row", "_file"}
    assert sorted((r["InvoiceNumber"], r["ChargeType"], r["UnitPrice"], r["OrderDate"], r["Note"], r["MSRPPrice"]) for r in rows.collect()) == [
        ("INV1", "USAGE", "1.5", "03/05/2024", "a\nb", ""), ("INV2", "SEAT", "", "soon", "", "")]


def test_rules_are_compiled_and_rows_asked_once(table):
    """no lambda over the rules, and one search for dropped characters a row, not a cell."""
    raw = table("Id,Name,Quantity,Subtotal,Note,OrderDate", ("1", "a​\u0007\tb  c", "1e40", "$5.50", " x ", "soon"))
    found = imports.normalise_findings(raw)
    rows = imports.in_one_pass(raw, fixed.MICROSOFT)
    for plan in (found, rows):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction" not in text
        assert sum(len(line.split(r"RLIKE [\p{C}")) - 1 for line in text.splitlines()) <= 1
    assert sorted((r["column"], r["description"]) for r in found.collect()) == [
        ("OrderDate", "Invalid date 'soon' – unable to parse."), ("Quantity", "Number '1e40' is out of range.")]


def test_cells_next_to_odd_ones(table):
    plain = ("7", "00a", "012", "(5)", "x", "2024-02-03")
    raw = table("Id,Name,Quantity,Subtotal,Note,OrderDate",
                plain, ("8", "a​\u0007\tb  c", "1e40", "1E2", " x\n\ny", "2024-02-30"), ("9", "|", "n/a", "$1,5", "", ""), plain)
    got = [tuple(r) for r in imports.normalise(raw).orderBy("Id").collect()]
    read = ("7", "a", "12", "-5", "x", "2024-02-03")
    assert got == [read, read, ("8", "a b c", "1e40", "100", "x y", "2024-02-30"), ("9", "|", "n/a", "15", "", "")]
    found = sorted((r["column"], r["raw_value"], r["description"].split(" ")[0]) for r in imports.normalise_findings(raw).collect())
    assert found == [("OrderDate", "2024-02-30", "Invalid"), ("Quantity", "1e40", "Number"), ("Quantity", "n/a", "Invalid")]
    noted = imports.in_one_pass(raw.withColumn("ProductId", F.lit("p")).withColumn("CustomerDomainName", F.lit("c")), fixed.MICROSOFT)
    assert noted.where(F.size("_found") > 0).count() == 4  # both negative totals and the odd rows


def test_import_writes_what_a_row_adds(spark, tmp_path):
    """neither columns that are blank in every row nor what the place tells are written, and rows pass without being exploded."""
    path = write(tmp_path / "G0 50%+.csv", "CustomerDomainName,ProductId,SkuId,ChargeType,TermAndBillingCycle,Subtotal",
                 ("c.com", "p", "1", "x", "", "5-"), ("", "p", "2", "x", "", "n/a"))
    feed = imports.import_feed(spark, path)
    held = spark.read.parquet(feed.rows.inputFiles()[0])
    assert set(held.columns) == {"CustomerDomainName", "ProductId", "SkuId", "ChargeType", "TermAndBillingCycle", "Term", "BillingCycle",
                                 "Subtotal", "_place", "_found", "_keyed", "_kept"}
    assert held.schema["_found"].dataType.elementType.names == ["what", "description", "raw_value", "context"]
    row, = feed.rows.collect()
    assert (row["Subtotal"], row["PartnerId"], row["Total"], row["_row"], row["_file"]) == ("-5", "", "", 1, "G0 50%+.csv")
    assert set(feed.rows.columns) == {*fixed.CANONICAL_COLUMNS, "_row", "_file"}
    found = feed.findings.where("row > 0").collect()
    assert sorted((r["row"], r["rule"], r["file_name"], r["is_summary"]) for r in found) == [
        (1, "Q5", "G0 50%+.csv", False), (2, "Q7", "G0 50%+.csv", False)]
    assert [(r["_row"], r["_file"]) for r in feed.rejects.collect()] == [(2, "G0 50%+.csv")]
    plan = imports.in_one_pass(feeds.scan_places(spark, path), fixed.MICROSOFT)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_unfilled_columns_are_blank(table):
    """Of every kind, and with old names, templates and lists of names."""
    for kind, header in ((fixed.MICROSOFT, "ProductId,Total"), (fixed.PARTNER, "PartNumber,ResourceName,ValidFrom,Quantity"),
                         (fixed.DISTRIBUTOR, "OrderNumber,CustomerUnitPrice,Sku")):
        raw = table(header, *[tuple(str(i + j) for j in range(header.count(",") + 1)) for i in (1, 7)])
        options = imports._with_old_names(raw, Options(), kind) if kind != fixed.MICROSOFT else Options()
        unfilled = sc.unfilled(raw, kind, options)
        rows = imports.in_one_pass(raw, kind).collect()
        assert unfilled and all(r[n] == "" for r in rows for n in unfilled)
        others = set(fixed.CANONICAL_COLUMNS) - set(unfilled)
        assert {n for n in others if all(r[n] == "" for r in rows)} <= {"CustomerDomainName", "ProductId", "Term", "BillingCycle"}


def test_row_numbers_shuffle_no_rows(spark, tmp_path):
    """offsets go to the rows whatever their estimated size, so findings and rejects are not shuffled for their numbers."""
    path = write(tmp_path / "G0_1.csv", "CustomerDomainName,ProductId,SkuId,ChargeType,TermAndBillingCycle,Total", ("", "p", "s", "x", "", "-1"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        feed = imports.import_feed(spark, path)
        for frame in feed[:1] + feed[2:] + (feed.findings.where("row > 0"),):
            plan, = _plans(frame)
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert [r["_row"] for r in feed.rejects.collect()] == [1] == [r["row"] for r in feed.findings.where("rule = 'Q5'").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

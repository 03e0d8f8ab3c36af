import random
from collections import Counter
from contextlib import contextmanager
from decimal import Decimal, InvalidOperation

from pyspark.sql import functions as F

from twinledger import Options
from twinledger.operators import field_diff as fd
from twinledger.operators import ordinals
from twinledger.operators.findings import search
from twinledger.operators.ordinals import running_number

H = "InvoiceNumber,SkuId,Quantity,Subtotal,TaxTotal,Total"


def test_missing_keys(table):
    left, right = table(H, ("INV1", "s1", "1", "5", "0", "5")), table(H, ("INV2", "s2", "1", "5", "0", "5"))
    rows = {(r["Our Value"], r["Explanation"], r["Reason"]) for r in fd.field_differences(left, right).collect()}
    assert rows == {("INV1|S1", "Missing in Microsoft", "Missing in Microsoft"),
                    ("INV2|S2", "Missing in MSPHub", "Missing in MSPHub")}


def test_equal_and_different(table):
    right = table(H, ("INV1", "s1", "1", "5", "0", "3"))
    assert fd.field_differences(table(H, ("inv1", "S1", "1.00", "5", "", "3")), right).count() == 0
    rows = fd.field_differences(table(H, ("INV1", "s1", "2", "7", "1", "7")), right).collect()
    for side in ("MSPHub", "Microsoft"):
        assert sorted(r["Field Name"] for r in rows if r["Side"] == side) == ["Quantity", "Subtotal", "TaxTotal", "Total"]


def test_duplicates_multiply(table):
    same, other = ("INV1", "s1", "1", "5", "0", "3"), ("INV1", "s1", "2", "7", "1", "7")
    left, right = table(H, same, other), table(H, same, same)
    rows = fd.field_differences(left, right).collect()
    assert sum(r["PairCount"] for r in rows if r["Side"] == "MSPHub") == 8
    assert sum(r["PairCount"] for r in rows if r["Side"] == "Microsoft") == 8
    assert fd.discrepancy_count(left, right).first()["summary"] == "Discrepancies found: 8"


def test_rows_of_a_key_do_not_depend_on_its_size(table):
    same, other = ("INV1", "s1", "1", "5", "0", "3"), ("INV1", "s1", "2", "7", "1", "7")

    def shape(n):
        found = fd.field_differences(table(H, *[same, other] * n), table(H, *[same] * n))
        return found.schema, sorted((r["Field Name"], r["Side"], r["Our Value"], r["Microsoft Value"], r["Explanation"],
                                     r["RowCount"] // n, r["PairCount"] // n ** 2) for r in found.collect())
    assert shape(1) == shape(40)


def test_scans_and_joins_of_the_plan(table, spark):
    left, right = table(H, ("I", "s", "1", "5", "0", "3")), table(H, ("I", "s", "2", "5", "0", "3"))
    plan = fd.field_differences(left, right)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 6 and "Cross" not in plan


def test_keys_are_not_trimmed(table):
    left, right = table(H, ("INV1 ", "s1", "1", "5", "0", "3")), table(H, ("INV1", "s1", "1", "5", "0", "3"))
    assert fd.missing_keys(left, right).count() == 2


def test_row_numbers_in_explanation(table):
    left = table(H, ("I", "s", "1", "5", "0", "3")).withColumn("_row", F.lit(4))
    right = table(H, ("I", "s", "2", "5", "0", "3")).withColumn("_row", F.lit(9))
    rows = {r["Explanation"] for r in fd.field_differences(left, right).collect()}
    assert rows == {"Mismatch in Quantity (Hub row 4)", "Mismatch in Quantity (MS row 9)"}


def money(s):
    s = s.strip()
    if not s:
        return Decimal(0)
    try:
        return Decimal(s)
    except InvalidOperation:
        return None


def equal(a, b):
    da, db = money(a), money(b)
    if da is not None and db is not None:
        return abs(da - db) <= Decimal("0.01")
    return a.strip().upper() == b.strip().upper()


def test_hot_keys_against_brute_force(spark, table):
    rng = random.Random(11)

    def cell():
        # Near range edges, equal texts in other cases, blanks and far values.
        return rng.choice([
            f"{rng.choice([0, 10, 20, -10]) + rng.randint(-3, 3) / 100:.2f}", "9.995", "10.005", "-0.004",
            "n/a", "N/A", "", "  ", "1e1", "xyz", str(rng.randint(0, 40)),
        ])
    left_rows = [("hot", rng.choice("ab"), cell(), cell(), cell(), cell()) for _ in range(90)]
    right_rows = [("HOT", rng.choice("ABC"), cell(), cell(), cell(), cell()) for _ in range(70)]
    left, right = table(H, *left_rows), table(H, *right_rows)
    fields = ("Quantity", "Subtotal", "TaxTotal", "Total")
    expected = Counter()
    for l in left_rows:
        for r in right_rows:
            if l[1].upper() == r[1].upper():
                for i, f in enumerate(fields):
                    if not equal(l[i + 2], r[i + 2]):
                        expected[(l[1].upper(), f, l[i + 2])] += 1

    theirs = Counter()
    for l in left_rows:
        for r in right_rows:
            if l[1].upper() == r[1].upper():
                for i, f in enumerate(fields):
                    if not equal(l[i + 2], r[i + 2]):
                        theirs[(l[1].upper(), f, r[i + 2])] += 1
    rows = fd.field_differences(left, right).where("`Field Name` <> 'Row'").collect()
    assert {(r["SkuId"], r["Field Name"], r["Our Value"]): r["PairCount"] for r in rows if r["Side"] == "MSPHub"} == expected
    assert {(r["SkuId"], r["Field Name"], r["Microsoft Value"]): r["PairCount"] for r in rows if r["Side"] == "Microsoft"} == theirs
    per_field = {(r["SkuId"], r["Field"]): r["pairs"] for r in fd.difference_counts(left, right).collect()}
    total = Counter()
    for (sku, f, _), n in expected.items():
        total[(sku, f)] += n
    assert per_field == dict(total)
    missing = fd.missing_keys(left, right).collect()
    assert [(r["SkuId"], r["Explanation"]) for r in missing] == [("C", "Missing in MSPHub")]


def test_search(table):
    df = table("Field Name,Explanation", ("Total", "x"), ("Row", "Missing"), ("Tax's", "y"))
    assert search(df, "TOT").count() == 1 and search(df, "s").count() == 2 and search(df, "tax's").count() == 1
    assert search(df, " ").count() == 3


def test_running_number(spark):
    df = spark.range(0, 1000, 1, 13).select((F.lit(999) - F.col("id")).alias("id"))
    rows = running_number(df, ["id"], "n").collect()
    assert sorted((r["id"], r["n"]) for r in rows) == [(i, i + 1) for i in range(1000)]


@contextmanager
def many_partitions(spark, n):
    """So many shuffle partitions, and none of them joined."""
    new = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_running_number_of_text_with_a_common_prefix(spark):
    values = [(f"INV-2024-{i * 7919 % 3000 // 3:07d}", i if i % 50 else None) for i in range(3000)] + [(None, 1), ("", None)]
    df = spark.createDataFrame(values, "name string, line long").repartition(3)
    rows = running_number(df, ["name", "line"], "n").collect()
    ranked = sorted(values, key=lambda v: (v[0] is not None, v[0] or "", v[1] is not None, v[1] or 0))
    assert [(r.name, r.line) for r in sorted(rows, key=lambda r: r.n)] == ranked
    assert [r.n for r in sorted(rows, key=lambda r: r.n)] == list(range(1, len(values) + 1))
    # Names with one prefix, and rows with one name, are dealt over many buckets.
    same = spark.createDataFrame([("x", i) for i in range(3000)], "name string, line long")
    for frame in (df, same):
        with many_partitions(spark, 100):
            sizes = [r["count"] for r in ordinals._ranges(frame, ["name", "line"])[0].groupBy("_place.block").count().collect()]
        assert sum(sizes) == frame.count() and max(sizes) <= 90
    empty = spark.createDataFrame([], "name string, line long")
    assert running_number(empty, ["name"]).count() == 0


def test_large_and_ordinary_keys_alike(table, monkeypatch):
    rng = random.Random(5)

    def rows(n):
        return [(f"I{rng.randrange(5)}", "s", *[rng.choice(("1", "1.01", "1.02", "n/a", "N/A", "", "7")) for _ in range(4)]) for _ in range(n)]
    left, right = table(H, *rows(60), ("L", "s", "1", "1", "1", "1")), table(H, *rows(50), ("R", "s", "1", "1", "1", "1"))
    found = []
    for bound in (0, 25, 1000):
        monkeypatch.setattr(fd, "LARGE_KEY", bound)
        found.append((Counter(map(tuple, fd.field_differences(left, right).collect())),
                      Counter(map(tuple, fd.difference_counts(left, right).collect())), fd.discrepancy_count(left, right).first()))
    assert found[0] == found[1] == found[2] and found[0][2]["discrepancies"] > 2


def test_cells_of_ordinary_keys_are_not_shuffled(table):
    left, right = table(H, ("I", "s", "1", "5", "0", "3")), table(H, ("I", "s", "2", "5", "0", "3"))
    found = fd.field_differences(left, right)
    assert [r["Field Name"] for r in found.collect()] == ["Quantity", "Quantity"]
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in final.split("\n") if "Exchange hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "Field" in line]

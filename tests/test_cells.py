from decimal import Context, Decimal

import pytest
from pyspark.sql import functions as F

from twinledger.functions import dates as dt
from twinledger.functions import numbers as num
from twinledger.functions import text as tx
from twinledger.functions.arithmetic import arithmetic

# cell, lenient, rule, money, whole, normal text
NUMBERS = [
    ("1", 1, 1, 1, 1, "1"),
    ("1,234.50", "1234.50", "1234.50", None, 0, "1234.50"),
    ("(5.00)", -5, None, None, 0, "-5.00"),
    ("5-", -5, -5, -5, 0, "-5"),
    (" 7 ", 7, 7, None, 7, "7"),
    ("1E2", 100, None, 100, 0, "100"),
    ("$1,234.50", None, None, None, 0, "1234.50"),
    ("abc", None, None, None, 0, None),
    ("", None, None, 0, 0, None),
    ("  ", None, None, 0, 0, None),
    ("0E-20", 0, None, 0, 0, "0"),
    (".5", "0.5", "0.5", "0.5", 0, "0.5"),
    ("30.0", 30, 30, 30, 0, "30.0"),
    ("-0", 0, 0, 0, 0, "0"),
    ("0012.50", "12.50", "12.50", "12.50", 0, "12.50"),
    ("+5-", None, None, None, 0, "-5"),
    ("1234567890123", "1234567890123", "1234567890123", "1234567890123", 0, "1234567890123"),
    ("7.9E28", "79000000000000000000000000000", None, "79000000000000000000000000000", 0, "79000000000000000000000000000"),
    ("123456789012345678901234567890123", None, None, None, 0, "123456789012345678901234567890123"),
]


def test_number_grammars(spark):
    cells = spark.createDataFrame([(i, r[0]) for i, r in enumerate(NUMBERS)], "i int, s string")
    s = F.col("s")
    got = cells.select(
        "i", num.lenient_decimal(s), num.rule_decimal(s), num.money_decimal(s), num.whole_or_zero(s),
        num.number_text(s),
    ).orderBy("i").collect()

    def amount(x):
        return None if x is None else Decimal(str(x)).quantize(Decimal("0.000001"), context=Context(prec=40))
    for row, (cell, lenient, rule, money, whole, text) in zip(got, NUMBERS):
        assert tuple(row)[1:] == (amount(lenient), amount(rule), amount(money), whole, text), cell


@pytest.mark.parametrize("cell,day", [
    ("2024-01-02", "2024-01-02"), ("2024-1-2", "2024-01-02"), ("01/02/2024", "2024-01-02"),
    ("1/2/2024 10:11:12", "2024-01-02"), ("2024-01-02T10:11:12.123Z", "2024-01-02"),
    ("2024/01/02", "2024-01-02"), ("1/2/2024 1:02:03 PM", "2024-01-02"), ("2 Jan 2024", "2024-01-02"),
    ("January 2, 2024", "2024-01-02"), ("2024-01-02T23:11:12-05:00", "2024-01-03"),
    ("13/13/2024", None), ("2024-02-30", None), ("soon", None), ("", None), ("4.5", None), ("2024", None),
])
def test_dates(spark, cell, day):
    row = spark.createDataFrame([(cell,)], "s string").select(dt.date_text(F.col("s"))).first()
    assert row[0] == day


def test_shown_numbers(spark):
    row = spark.range(1).select(
        num.short(F.lit(Decimal("20.050000"))), num.short(F.lit(Decimal("-1.005"))),
        num.signed(F.lit(Decimal("-1.000"))), num.signed(F.lit(Decimal("0.125"))),
        num.short_if_number(F.lit("12.345%")), num.short_if_number(F.lit("n/a")),
    ).first()
    assert tuple(row) == ("20.05", "-1.01", "-1", "+0.13", "12.35%", "n/a")


def test_clean_text(spark):
    row = spark.range(1).select(
        tx.clean(F.lit("\t a\u0007b \n")), tx.collapse_spaces(F.lit("a \t b")), tx.strip_leading_zeros(F.lit("0070")),
        tx.key(F.lit(" a.Com\t")), tx.or_missing(F.lit(" ")), tx.friendly(F.lit("skuid")), tx.friendly(F.lit("x")),
    ).first()
    assert tuple(row) == ("ab", "a b", "70", "A.COM", "(missing)", "Product Code", "x")


def test_arithmetic(table):
    df = table("A,B,Z", ("1", "3", "0"))

    def value(name):
        return num.amount(df, name)

    def run(template):
        return df.select(arithmetic(template, value)).first()[0]
    assert run("{A}+{B}*2") == 7
    assert run("{A}+{Missing}") == 1
    assert run("({A} - {B}) / 4") == Decimal("-0.5")
    assert run("{A} / {Z}") == 0
    assert run("") == 0
    for bad in ("__import__('os')", "{A} ** {B}", "{A}; 1", "{A} +", "abc"):
        with pytest.raises(ValueError):
            arithmetic(bad, value)


def test_short_ways_give_what_the_long_ones_give(spark):
    """Plain days and negative amounts, and texts just beside them."""
    amounts = ["(17)", "(017)", "(1.50)", "(0)", "()", "17-", "17.250-", "017-", "0-", "-17-", "17.-", ".5-", "1,700-", "(17", "17)", "(17)-", "17-\n", "1 7-"]
    tidy = lambda c: F.when(c.rlike(num.CANONICAL), c).when(c.rlike(num.LENIENT), num._tidy_digits(c))
    cells = spark.createDataFrame([(a,) for a in amounts], "s string")
    for r in cells.select("s", num.lenient_number_text(F.col("s")).alias("got"), tidy(F.col("s")).alias("long")).collect():
        assert r["got"] == r["long"], r
    days = ["2024-01-02", "2024-01-02\n", " 2024-01-02", "2024-02-30", "1/2/2024", "01/02/0099", " 1/2/2024 ", "1/2/2024\n", "2/30/2024", "0/1/2024", "12/31/9999", "1/2/24"]
    cells = spark.createDataFrame([(d,) for d in days], "s string")
    for r in cells.select("s", dt.date_text(F.col("s")).alias("got"), dt.parse_date(F.col("s")).cast("string").alias("long")).collect():
        assert r["got"] == r["long"], r


def test_blank_and_printable(spark):
    cells = ["", " ", "\t", "\u00a0", "\u0085 ", "\u3000", "\u007f", "a", " a", "~", "!", "ä", "\ta", "a\n", "\u200b", None]
    df = spark.createDataFrame([(c,) for c in cells], "s string")
    white = set(tx.WHITESPACE)
    for r in df.select("s", tx.is_blank(F.col("s")).alias("blank"), tx.is_printable_ascii(F.col("s")).alias("plain")).collect():
        assert r["blank"] == (r["s"] is None or set(r["s"]) <= white), r
        assert r["plain"] == (None if r["s"] is None else all(" " <= c <= "~" for c in r["s"])), r


def test_what_may_be_a_number(spark):
    texts = [c for c, *_ in NUMBERS if c.strip()] + ["(5)", "+1", "-1", ",1"]
    df = spark.createDataFrame([(t.strip(),) for t in texts], "s string")
    assert df.where(F.col("s").rlike(num.LENIENT) & ~num.may_be_number(F.col("s"))).count() == 0
    assert df.where(~num.may_be_number(F.col("s"))).count() > 0

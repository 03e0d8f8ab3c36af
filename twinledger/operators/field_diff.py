"""Field comparison per composite key (invoice number and SKU), many rows to many.

Every left row of a key is compared with every right row of it, so the row pairs grow
with the product of a key's rows. They are counted exactly and never formed: values are
made distinct per key and field, and a sliding sum over ranges of amounts counts the
other side's rows within tolerance (``value_counts``). The result has one shape for keys
of any size: per key, field and distinct value of either side its rows and the row pairs
in which it differs, and one row per key found on one side only.

Keys of up to ``LARGE_KEY`` rows are dealt by key once, as whole rows; only the fields in
which a key's rows hold unlike text are cut into cells, and all later steps stay in that
deal. The few larger keys are cut into cells first and combined before any shuffle.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import numbers as num
from ..functions import text as tx
from ..options import DEFAULTS, Options
from ..staging import written
from .schema import ROW

KEYS = ("InvoiceNumber", "SkuId")
LARGE_KEY = 10_000  # rows of both sides; a task holds the rows of one key up to this number
_UNITS = 1_000_000  # an amount of six decimals as a whole number


def _key(df: DataFrame, name: str) -> Column:
    """Upper-cased, not trimmed."""
    return F.upper(tx.cell(df, name))


def _fields(left: DataFrame, right: DataFrame) -> list[str]:
    return [f for f in fixed.DIFF_FIELDS if tx.find(left, f) and tx.find(right, f)]


def _side(df: DataFrame, fields: list[str]) -> DataFrame:
    row = F.col(ROW) if ROW in df.columns else F.lit(None)
    return df.select(
        *[_key(df, k).alias(k) for k in KEYS],
        *[tx.cell(df, f).alias(f) for f in fields],
        row.cast("long").alias(ROW),
    )


def key_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows per key on each side, from one grouping over both feeds."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    l = left.select(*[_key(left, k).alias(k) for k in KEYS], one.alias("left_rows"), zero.alias("right_rows"))
    r = right.select(*[_key(right, k).alias(k) for k in KEYS], zero.alias("left_rows"), one.alias("right_rows"))
    return l.unionByName(r).groupBy(*KEYS).agg(
        F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows")
    )


def missing_keys(left: DataFrame, right: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One row per key found on one side only."""
    return _missing(key_rows(left, right), options).select(*KEYS, "Explanation")


def _missing(keys: DataFrame, options: Options) -> DataFrame:
    side = F.when(F.col("left_rows") == 0, options.missing_left).otherwise(options.missing_right)
    found = F.when(F.col("left_rows") == 0, options.right_label).otherwise(options.left_label)
    return keys.where("left_rows = 0 OR right_rows = 0").select(
        *KEYS, side.alias("Explanation"), found.alias("Side"), (F.col("left_rows") + F.col("right_rows")).alias("RowCount"))


def _rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of both feeds with their compared fields."""
    fields = _fields(left, right)
    return _side(left, fields).withColumn("is_left", F.lit(True)).unionByName(
        _side(right, fields).withColumn("is_left", F.lit(False)))


def _cells(rows: DataFrame, fields: list[str], *more: str, shown: dict[str, Column] | None = None) -> DataFrame:
    """One row per cell, of the fields that are shown in a row if that is given."""
    def cell(f: str) -> Column:
        made = F.struct(F.lit(f).alias("Field"), F.col(f).alias("value"))
        return made if shown is None else F.when(shown[f], made)

    cells = F.array(*[cell(f) for f in fields])
    return rows.select(*KEYS, ROW, "is_left", *more, F.explode(cells if shown is None else F.array_compact(cells)).alias("c")).select(
        *KEYS, ROW, "is_left", *more, "c.*")


def _profile(cells: DataFrame, *more: str) -> DataFrame:
    """Distinct cell values per key and field with each side's rows and first row: combined before the shuffle."""
    mine, theirs = F.col("is_left"), ~F.col("is_left")
    return cells.groupBy(*KEYS, *more, "Field", "value").agg(
        F.count_if(mine).alias("left_rows"), F.count_if(theirs).alias("right_rows"),
        F.min(F.when(mine, F.col(ROW))).alias("left_first"), F.min(F.when(theirs, F.col(ROW))).alias("right_first"),
    )


def value_counts(left: DataFrame, right: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Per key, field and distinct value: each side's rows, and how many of the other side's rows count as equal."""
    return _equal_counts(_profile(_cells(_rows(left, right), _fields(left, right))), options)


def _equal_counts(profile: DataFrame, options: Options, *more: str) -> DataFrame:
    """A profile with the other side's rows that count as equal.

    Amounts are equal within tolerance (blank is 0), other text when the same ignoring case.
    Amounts are cut into ranges; values near a range's edge are copied to the neighbouring range,
    and a sliding sum inside each range counts. Values are distinct, so a range holds a bounded
    number of rows however many the key has.
    """
    tolerance = int(options.numeric_tolerance * _UNITS)
    margin = Decimal(tolerance) / _UNITS
    width = max(1, math.ceil(4 * margin))
    value = tx.strip(F.col("value"))
    money = num.money_decimal(value)
    measured = profile.select(
        "*",
        F.coalesce(money, F.lit(0).cast(num.AMOUNT)).alias("money"),
        F.when(money.isNull(), F.upper(value)).otherwise("").alias("text"),
        money.isNotNull().alias("is_amount"),
    )

    def range_of(m: Column) -> Column:
        return F.floor(m if width == 1 else m / F.lit(width)).cast("decimal(38,0)")

    m = F.col("money")
    ranges = F.when(F.col("is_amount"), F.array_distinct(F.array(
        range_of(m), range_of(m - F.lit(margin)), range_of(m + F.lit(margin))))).otherwise(F.array(range_of(m)))
    marks = measured.withColumn("range", F.explode(ranges)).withColumn(
        "place", ((m - F.col("range") * F.lit(width)) * _UNITS).cast("long"))
    group = [*KEYS, "Field", "is_amount", "text", "range"]
    near = Window.partitionBy(*group).orderBy("place").rangeBetween(-tolerance, tolerance)
    counted = marks.withColumns({
        "right_equal": F.sum("right_rows").over(near), "left_equal": F.sum("left_rows").over(near),
    }).where((F.col("place") >= 0) & (F.col("place") < width * _UNITS))
    return counted.select(
        *KEYS, "Field", "value", "left_rows", "right_rows", "left_first", "right_first", "left_equal", "right_equal", *more)


_TOTALS = ("left_total", "right_total")


def _with_pairs(counted: DataFrame) -> DataFrame:
    """The differing row pairs of each side's rows. Every field of a key has as many rows as the key."""
    return counted.withColumns({
        "left_pairs": F.col("left_rows") * (F.col("right_total") - F.col("right_equal")),
        "right_pairs": F.col("right_rows") * (F.col("left_total") - F.col("left_equal")),
    })


def _pairs(left: DataFrame, right: DataFrame, keys: DataFrame, options: Options) -> list[DataFrame]:
    """The values of the keys on both sides with their differing row pairs: those of ordinary keys, and of large ones.

    Fields in which all rows of an ordinary key hold one text are left out; they have no differing pair.
    """
    fields, rows = _fields(left, right), _rows(left, right)
    large = F.broadcast(keys.where(F.col("left_rows") + F.col("right_rows") > LARGE_KEY).select(
        *KEYS, F.col("left_rows").alias("left_total"), F.col("right_rows").alias("right_total")))
    key = Window.partitionBy(*KEYS)
    unlike = {f: F.min(f).over(key) != F.max(f).over(key) for f in fields}
    ordinary = rows.join(large, list(KEYS), "left_anti").withColumns({
        "left_total": F.count_if(F.col("is_left")).over(key), "right_total": F.count_if(~F.col("is_left")).over(key),
        **{f"unlike_{f}": c for f, c in unlike.items()},
    }).where("left_total > 0 AND right_total > 0")
    cells = _cells(ordinary, fields, *_TOTALS, shown={f: F.col(f"unlike_{f}") for f in fields})
    few = _equal_counts(_profile(cells, *_TOTALS), options, *_TOTALS)
    both = large.where("left_total > 0 AND right_total > 0")
    many = _equal_counts(_profile(_cells(rows.join(both, list(KEYS), "left_semi"), fields)), options).join(both, list(KEYS))
    return [_with_pairs(few), _with_pairs(many)]


def _difference_counts(left: DataFrame, right: DataFrame, keys: DataFrame, options: Options) -> DataFrame:
    few, many = [
        found.groupBy(*KEYS, "Field").agg(
            F.sum("left_rows").alias("left_rows"), F.max("right_total").alias("right_rows"), F.sum("left_pairs").alias("pairs"),
        ).where("pairs > 0") for found in _pairs(left, right, keys, options)]
    return few.unionByName(many)


def _held_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """``key_rows``, written once: large keys, one-sided keys and their totals are read from it."""
    return written(key_rows(left, right), "keys")


def difference_counts(left: DataFrame, right: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Differing row pairs per key and field, exact and without forming pairs."""
    return _difference_counts(left, right, _held_keys(left, right), options)


def field_differences(left: DataFrame, right: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Differing values of either side and one-sided keys.

    Columns: the two keys, field name, side, our value, their value (empty on rows of the other
    side), explanation with the value's first row number if rows are numbered, suggested action,
    reason, RowCount and PairCount. A value's PairCount is the number of row pairs in which it
    differs; the left side's values and the one-sided keys sum to the number of discrepancies.
    """
    keys = _held_keys(left, right)
    empty = F.lit("")
    one = F.lit(1).cast("long")

    def side(label: str, name: str, prefix: str, ours: Column, theirs: Column) -> Column:
        first = F.col(f"{name}_first").cast("string")
        where = F.coalesce(F.concat(F.lit(f" ({prefix} row "), first, F.lit(")")), empty)
        return F.struct(
            F.lit(label).alias("Side"), ours.alias("ours"), theirs.alias("theirs"), where.alias("where"),
            F.col(f"{name}_rows").alias("RowCount"), F.col(f"{name}_pairs").alias("PairCount"))

    value = F.col("value")
    few, many = _pairs(left, right, keys, options)
    found = few.unionByName(many.select(*few.columns)).select(*KEYS, "Field", F.explode(F.array(
        side(options.left_label, "left", options.left_prefix, value, empty),
        side(options.right_label, "right", options.right_prefix, empty, value),
    )).alias("s")).where("s.PairCount > 0")
    their_name = f"{options.right_label} Value"
    result = found.select(
        *KEYS, tx.friendly(F.col("Field")).alias("Field Name"), "s.Side", F.col("s.ours").alias("Our Value"),
        F.col("s.theirs").alias(their_name), F.concat(F.lit("Mismatch in "), F.col("Field"), F.col("s.where")).alias("Explanation"),
        empty.alias("Suggested Action"), empty.alias("Reason"), "s.RowCount", "s.PairCount",
    )
    return result.unionByName(_missing(keys, options).select(
        *KEYS, F.lit("Row").alias("Field Name"), "Side", F.concat_ws("|", *KEYS).alias("Our Value"),
        empty.alias(their_name), "Explanation", empty.alias("Suggested Action"),
        F.col("Explanation").alias("Reason"), "RowCount", one.alias("PairCount"),
    ))


def discrepancy_count(left: DataFrame, right: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One row: differing pairs plus one-sided keys, with the summary line."""
    keys = _held_keys(left, right)
    counts = _difference_counts(left, right, keys, options).select("pairs").unionAll(
        keys.where("left_rows = 0 OR right_rows = 0").select(F.lit(1).cast("long").alias("pairs")))
    total = counts.agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("discrepancies"))
    return total.withColumn("summary", F.format_string("Discrepancies found: %d", "discrepancies"))

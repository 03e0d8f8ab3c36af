"""Cell comparison row by row: row i of one feed against row i of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import dates as dt
from ..functions import numbers as num
from ..functions import text as tx
from ..options import DEFAULTS, Options
from .schema import ROW

_LEFT_GONE = "Row missing in left table"
_RIGHT_GONE = "Row missing in right table"


def _group_name(column: Column, explanation: Column) -> Column:
    name = F.lower(column)
    return (
        F.when(explanation.startswith("Row missing"), fixed.MISSING_ROWS)
        .when(name == "skuid", "Product Code mismatches")
        .when(name == "quantity", "Quantity mismatches")
        .when(F.contains(name, F.lit("date")), "Date mismatches")
        .otherwise("Other mismatches")
    )


def _action(group: Column) -> Column:
    action = F.lit("")
    for name, text in fixed.SUGGESTED_ACTIONS.items():
        action = F.when(group == name, text).otherwise(action)
    return action


def positional_differences(left: DataFrame, right: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Differing cells of rows with the same ordinal, and rows without a partner.

    Both frames carry a 1-based ordinal in ``_row``. The ordinals are unique, so
    the full outer join has no hot key. Cells equal as text are dropped inside
    the join's row; only the others are parsed as numbers or dates.
    """
    common = [c for c in left.columns if c != ROW and tx.find(right, c) is not None]
    l = left.select(F.col(ROW), F.struct(*[tx.cell(left, c).alias(c) for c in common]).alias("l"))
    r = right.select(F.col(ROW), F.struct(*[tx.cell(right, c).alias(c) for c in common]).alias("r"))

    def cell(name: str, a: Column, b: Column, gone: Column) -> Column:
        return F.struct(F.lit(name).alias("column"), a.alias("a"), b.alias("b"), gone.alias("gone"))

    def at(side: str, name: str) -> Column:
        return F.col(side).getField(name)

    none, empty = F.lit(None).cast("string"), F.lit("")
    unequal = [
        F.when(
            F.upper(tx.strip(at("l", c))) != F.upper(tx.strip(at("r", c))),
            cell(c, at("l", c), at("r", c), none),
        )
        for c in common
    ]
    gone = F.when(F.col("l").isNull(), _LEFT_GONE).when(F.col("r").isNull(), _RIGHT_GONE)
    cells = F.when(gone.isNotNull(), F.array(cell("", empty, empty, gone))).otherwise(
        F.array_compact(F.array(*unequal))
    )
    # The outer form: below the inner one all cells would be compared again in a filter on the array's size.
    rows = l.join(r, ROW, "full_outer").select(ROW, cells.alias("cells")).select(ROW, F.explode_outer("cells").alias("c"))
    rows = rows.where(F.col("c").isNotNull()).select(ROW, "c.*")

    a, b = F.col("a"), F.col("b")
    typed = tx.with_once(rows, {
        "da": num.lenient_decimal(a), "db": num.lenient_decimal(b),
        "ta": dt.parse_timestamp(a), "tb": dt.parse_timestamp(b),
    })
    lowered = F.lower("column")
    numeric = F.col("da").isNotNull() & F.col("db").isNotNull()
    dated = F.col("ta").isNotNull() & F.col("tb").isNotNull()
    per_day = F.contains(lowered, F.lit("perdayunitprice"))
    tolerance = F.when(per_day, F.lit(options.per_day_unit_tolerance)).otherwise(F.lit(options.numeric_tolerance))
    seconds = F.abs(F.col("ta").cast("double") - F.col("tb").cast("double"))
    equal_text = F.lit(False)
    if options.text_distance is not None:
        equal_text = F.levenshtein(tx.strip(a), tx.strip(b)) <= options.text_distance
    equal = (
        F.when(F.col("gone").isNotNull(), False)
        .when(numeric, F.abs(F.col("da") - F.col("db")) <= tolerance)
        .when(dated, seconds <= options.date_tolerance_days * 86400)
        .otherwise(equal_text)
    )
    name = tx.friendly(F.col("column"))
    explanation = F.coalesce(
        F.col("gone"),
        F.when(numeric, F.concat(F.lit("Numeric mismatch in "), name, F.lit(": "), num.short(F.col("da")),
                                 F.lit(" vs "), num.short(F.col("db")))),
        F.when(dated, F.concat(F.lit("Date mismatch in "), name, F.lit(": "), F.date_format("ta", "M/d/yyyy"),
                               F.lit(" vs "), F.date_format("tb", "M/d/yyyy"))),
        F.concat(F.lit("Text mismatch in "), name, F.lit(": '"), a, F.lit("' vs '"), b, F.lit("'")),
    )
    kept = typed.where(~equal).withColumn("Explanation", explanation)
    kept = kept.withColumn("Group", _group_name(F.col("column"), F.col("Explanation")))
    return kept.select(
        F.col(ROW).alias("Row Number"),
        F.col("column").alias("Column"),
        name.alias("Field Name"),
        num.short_if_number(a).alias("Our Value"),
        num.short_if_number(b).alias(f"{options.right_label} Value"),
        "Explanation",
        _action(F.col("Group")).alias("Suggested Action"),
        "Group",
    )


def order_differences(diffs: DataFrame) -> DataFrame:
    return diffs.orderBy("Row Number", F.lower("Column"))


def group_counts(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("Group").agg(F.count(F.lit(1)).alias("n"))


def summarise_positional(left: DataFrame, right: DataFrame, diffs: DataFrame) -> DataFrame:
    """One row: rows compared (the longer side), discrepancies, counts per group, summary line."""
    sides = left.select(F.lit("left").alias("side")).unionByName(right.select(F.lit("right").alias("side")))
    sizes = sides.groupBy("side").agg(F.count(F.lit(1)).alias("rows"))
    groups = group_counts(diffs)
    parts = sizes.unionByName(groups, allowMissingColumns=True)
    line = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("Group"))
    named = F.sort_array(F.collect_list(F.when(F.col("Group").isNotNull(), line)))
    return parts.agg(
        F.coalesce(F.max("rows"), F.lit(0)).cast("long").alias("rows_compared"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("discrepancies"),
        F.concat(F.lit("Summary: "), F.array_join(named, ", ")).alias("summary"),
    )

"""Totals comparison per business key (customer domain and product).

Both feeds are unioned, each filling its own set of total columns, and grouped
once. One hash aggregation with map-side combine replaces two aggregations and
a full outer join: nothing is sorted, and a key of any size reaches its task as
one partial row per input partition. Statuses, diagnostics, run log and summary
are projections of that one grouped frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import numbers as num
from ..functions import text as tx
from ..options import DEFAULTS, Options
from ..staging import written
from .filters import is_excluded, partner_condition, slice_partner
from .schema import prepare_side

KEYS = ("CustomerDomainName", "ProductId")
_MEASURES = (*fixed.TOTALS, "Weighted")


def _measures(df: DataFrame) -> dict[str, Column]:
    quantity = num.amount(df, "Quantity")
    return {
        "Quantity": quantity,
        "Subtotal": num.amount(df, "Subtotal", "PartnerSubTotal"),
        "Total": num.amount(df, "Total", "PartnerTotal"),
        "TaxTotal": num.amount(df, "TaxTotal", "PartnerTaxTotal"),
        "Weighted": F.try_multiply(num.amount(df, "UnitPrice", "PartnerUnitPrice"), quantity),
    }


_SOURCES = (("Quantity", None), ("Subtotal", "PartnerSubTotal"), ("Total", "PartnerTotal"), ("TaxTotal", "PartnerTaxTotal"))
_TOTAL_SOURCES = dict(zip(fixed.TOTALS, _SOURCES))
OUT_OF_RANGE = "Amount out of range"


def _beyond(df: DataFrame) -> Column:
    """Whether a row has an amount that is too large to be held."""
    return reduce(lambda a, b: a | b, [num.is_beyond_range(df, *names) for names in _SOURCES])


def _one_side(df: DataFrame, is_left: bool) -> DataFrame:
    keys = [tx.key(tx.cell(df, k)).alias(k) for k in KEYS]
    values = _measures(df)
    mine = list(values.values())
    none = [F.lit(None).cast(num.AMOUNT)] * len(mine)
    first, second = (mine, none) if is_left else (none, mine)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return df.select(
        *keys,
        (one if is_left else zero).alias("left_rows"),
        (zero if is_left else one).alias("right_rows"),
        _beyond(df).alias("_beyond"),
        *[c.alias(f"l_{n}") for n, c in zip(_MEASURES, first)],
        *[c.alias(f"r_{n}") for n, c in zip(_MEASURES, second)],
    )


def _mean(weighted: str, quantity: Column) -> Column:
    """The weighted mean over the sum of quantities, NULL where it can't be held."""
    return F.try_divide(F.try_sum(weighted), quantity).try_cast(num.TOTAL)


def group_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts and totals of both sides per key; a total that can't be held is 0 and marks the key."""
    both = _one_side(left, True).unionByName(_one_side(right, False))
    zero = F.lit(0)
    sums, lost = [], F.bool_or("_beyond")
    for side, rows, feed in (("l", "left_rows", left), ("r", "right_rows", right)):
        totals = {n: num.wide_sum(F.col(f"{side}_{n}"), num.is_below_limb(feed, *_TOTAL_SOURCES[n])) for n in fixed.TOTALS}
        for name, total in totals.items():
            lost = lost | ((F.sum(rows) > 0) & total.isNull())
            sums.append(F.coalesce(total, zero).cast(num.TOTAL).alias(f"{side}_{name}"))
        sums.append(F.coalesce(_mean(f"{side}_Weighted", totals["Quantity"]), zero).cast(num.TOTAL).alias(f"{side}_UnitPrice"))
    sums.append(lost.alias("is_out_of_range"))
    # The flag is an aggregate although the keys decide it: a filter on it then stays above the
    # grouping, whose exchange the reports share.
    blank = F.bool_or((F.col(KEYS[0]) == "") | (F.col(KEYS[1]) == "")).alias("is_blank_key")
    return both.groupBy(*KEYS).agg(
        F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"), blank, *sums
    )


def key_totals(df: DataFrame) -> DataFrame:
    """Totals of one feed per key, with row count and an error flag: a blank key, or amounts that can't be held."""
    side = prepare_side(df)
    values = _measures(side)
    frame = side.select(
        *[tx.key(tx.cell(side, k)).alias(k) for k in KEYS], *[c.alias(n) for n, c in values.items()], _beyond(side).alias("_beyond")
    )
    totals = {n: num.wide_sum(F.col(n), num.is_below_limb(side, *_TOTAL_SOURCES[n])) for n in fixed.TOTALS}
    lost = reduce(lambda a, b: a | b, [t.isNull() for t in totals.values()], F.bool_or("_beyond"))
    return frame.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.coalesce(t, F.lit(0)).cast(num.TOTAL).alias(n) for n, t in totals.items()],
        F.coalesce(_mean("Weighted", totals["Quantity"]), F.lit(0)).cast(num.TOTAL).alias("UnitPrice"),
        (F.bool_or((F.col(KEYS[0]) == "") | (F.col(KEYS[1]) == "")) | lost).alias("has_error"),
    )


def _difference(name: str) -> Column:
    return num.difference(F.col(f"l_{name}"), F.col(f"r_{name}"))


def compare_keys(left: DataFrame, right: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """The grouped frame with a status per key: every report below reads this.

    Status is NULL for keys that are not reported: excluded tenants without a
    usable left key.
    """
    left, right = prepare_side(left), prepare_side(right)
    totals = group_totals(left, slice_partner(left, right))
    totals = totals.withColumn("is_excluded", is_excluded(F.col(KEYS[0]), options))
    equal = F.lit(True)
    for name in fixed.TOTALS:
        equal = equal & (F.abs(_difference(name)) <= F.lit(options.tolerance_for(name)))
    in_left, in_right = F.col("left_rows") > 0, F.col("right_rows") > 0
    skipped = F.col("is_excluded") & in_left & ~F.col("is_blank_key")
    status = (
        F.when(skipped, F.lit(fixed.DATA_ERROR))
        .when(F.col("is_excluded"), F.lit(None))
        .when(in_left & F.col("is_blank_key"), F.lit(fixed.DATA_ERROR))
        .when(F.col("is_out_of_range"), F.lit(fixed.DATA_ERROR))
        .when(~in_right, F.lit(options.missing_right))
        .when(~in_left, F.lit(options.missing_left))
        .when(equal, F.lit(fixed.MATCHED))
        .otherwise(F.lit(fixed.MISMATCHED))
    )
    return totals.withColumns({"Status": status, "is_skipped": skipped})


def _details(options: Options) -> Column:
    parts = [
        F.when(
            F.abs(_difference(n)) > F.lit(options.tolerance_for(n)),
            F.concat(F.lit(f"{n}:"), num.signed(_difference(n))),
        )
        for n in fixed.TOTALS
    ]
    lost = (F.col("Status") == fixed.DATA_ERROR) & F.col("is_out_of_range") & ~F.col("is_skipped")
    return F.when(F.col("Status") == fixed.MISMATCHED, F.concat_ws("; ", *parts)).when(lost, OUT_OF_RANGE).otherwise("")


def result_rows(keys: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """The comparison result: two keys, status, five pairs of totals, mismatch details."""
    shown = keys.where(F.col("Status").isNotNull())
    if options.hide_right_only:
        shown = shown.where(F.col("Status") != options.missing_left)
    if options.drop_excluded:
        shown = shown.where(~F.col("is_skipped"))
    zero = F.lit(0).cast(num.TOTAL)
    error = F.col("Status") == fixed.DATA_ERROR
    pairs = []
    for name in ("Quantity", "Subtotal", "Total", "UnitPrice", "TaxTotal"):
        pairs.append(
            F.when(F.col("is_skipped"), zero).otherwise(F.col(f"l_{name}"))
            .alias(f"{options.left_prefix}{name}")
        )
        pairs.append(F.when(error, zero).otherwise(F.col(f"r_{name}")).alias(f"{options.right_prefix}{name}"))
    columns = [*KEYS, "Status", *pairs, _details(options).alias("MismatchDetails")]
    if options.high_priority_threshold is not None:
        high = F.abs(_difference("Total")) >= F.lit(options.high_priority_threshold)
        reportable = F.col("Status").isin(fixed.MISMATCHED, options.missing_left, options.missing_right)
        columns.append(F.when(reportable & high, "High").otherwise("Low").alias("Priority"))
    return shown.select(*columns)


def compare_business_keys(left: DataFrame, right: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    return result_rows(compare_keys(left, right, options), options)


def order_result(result: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Left keys first, then right-only keys, each by key."""
    rank = F.when(F.col("Status") == options.missing_left, 1).otherwise(0)
    return result.orderBy(rank, *KEYS)


# --- Diagnostics over the grouped frame ------------------------------------------


def _usable_left() -> Column:
    return (F.col("left_rows") > 0) & ~F.col("is_blank_key")


def _usable_right() -> Column:
    return (F.col("right_rows") > 0) & ~F.col("is_blank_key")


def duplicate_keys(keys: DataFrame) -> DataFrame:
    """Left keys on more than one row; more than five rows is an error."""
    return keys.where(_usable_left() & (F.col("left_rows") > 1)).select(
        *KEYS,
        F.col("left_rows").alias("n"),
        F.when(F.col("left_rows") > 5, "ERROR").otherwise("WARN").alias("level"),
    )


def key_presence(keys: DataFrame) -> DataFrame:
    """Usable keys and where they occur: both, left or right."""
    return keys.where(_usable_left() | _usable_right()).select(
        *KEYS,
        F.when(F.col("right_rows") == 0, "left").when(F.col("left_rows") == 0, "right")
        .otherwise("both").alias("presence"),
    )


def keys_missing_right(keys: DataFrame) -> DataFrame:
    return keys.where(_usable_left() & (F.col("right_rows") == 0)).select(*KEYS)


def skipped_keys(keys: DataFrame) -> DataFrame:
    return keys.where("is_skipped").select(*KEYS)


def overlap_sample(keys: DataFrame, size: int = 10) -> DataFrame:
    return keys.where(_usable_left() & (F.col("right_rows") > 0)).select(*KEYS).orderBy(*KEYS).limit(size)


def duplicate_sample(keys: DataFrame, size: int = 5) -> DataFrame:
    return duplicate_keys(keys).orderBy(*KEYS).limit(size)


def key_counts(keys: DataFrame) -> DataFrame:
    """One row: unique usable keys per side and their overlap."""
    both = _usable_left() & (F.col("right_rows") > 0)
    return keys.agg(
        F.count_if(_usable_left()).alias("left_keys"),
        F.count_if(_usable_right()).alias("right_keys"),
        F.count_if(both).alias("overlap"),
    )


def key_diagnostics(keys: DataFrame) -> DataFrame:
    """Skipped and duplicate keys as an export table."""
    repeated = F.concat(F.lit("Duplicate x"), F.col("left_rows").cast("string"))
    issues = F.array_compact(F.array(
        F.when(F.col("is_skipped"), F.lit("Skipped")),
        F.when(_usable_left() & (F.col("left_rows") > 1), repeated),
    ))
    return keys.select(*KEYS, F.explode(issues).alias("Issue"))


def summarise(keys: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One row of status and key counts with the summary line."""
    def count(status: str) -> Column:
        return F.count_if(F.col("Status") == status)

    right_only = F.lit(0).cast("long") if options.hide_right_only else count(options.missing_left)
    counts = keys.agg(
        count(fixed.MATCHED).alias("matched"),
        count(options.missing_right).alias("missing_right"),
        right_only.alias("missing_left"),
        count(fixed.MISMATCHED).alias("mismatched"),
        count(fixed.DATA_ERROR).alias("data_errors"),
        F.count_if(_usable_left()).alias("total_keys"),
        F.count_if("is_skipped").alias("skipped"),
        F.count_if(_usable_left() & (F.col("left_rows") > 1)).alias("duplicates"),
    ).withColumn("reported", F.col("total_keys") - F.col("skipped"))
    line = F.format_string(
        f"Matched: %d | {options.missing_right}: %d | {options.missing_left}: %d | Mismatched: %d"
        f" | Data Errors: %d | Total unique {options.left_label} keys: %d; Reported: %d; Skipped: %d;"
        " Duplicates: %d",
        *[F.col(c) for c in ("matched", "missing_right", "missing_left", "mismatched", "data_errors",
                             "total_keys", "reported", "skipped", "duplicates")],
    )
    return counts.withColumn("summary", line)


def over_under_bill(keys: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One row: keys, unmatched keys, amounts billed above and below the other side."""
    shown = keys.where(F.col("Status").isNotNull() & ~F.col("is_skipped"))
    gap = _difference("Total")
    return shown.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("Status") != fixed.MATCHED).alias("unmatched_groups"),
        num.wide_sum(F.greatest(gap, F.lit(0)).try_cast(num.TOTAL)).alias("over_bill"),
        num.wide_sum(F.greatest(-gap, F.lit(0)).try_cast(num.TOTAL)).alias("under_bill"),
    )


def held_keys(keys: DataFrame) -> DataFrame:
    """What the log reads of the grouped frame, written once: its parts would each group again."""
    names = ("left_rows", "right_rows", "is_blank_key", "is_excluded", "is_skipped", "Status")
    return written(keys.select(*KEYS, *names), "keys")


def run_log(keys: DataFrame, options: Options = DEFAULTS, left: DataFrame | None = None,
            right: DataFrame | None = None) -> DataFrame:
    """The run's log as a table: level, message, occurrences.

    Messages about keys come from one pass over the grouped frame. Repeated
    messages (one per excluded row) are one row with their number. The full key
    lists are not put into a message; ``key_presence`` has them. Given the
    feeds, a partner mismatch is logged too. ``keys`` is read by every part: pass
    ``held_keys`` for large feeds.
    """
    # Always true, but it makes every part below need the same grouped columns, so that
    # the grouping's exchange is computed once and reused.
    keys = keys.where(F.col("Status").isNotNull() | F.col("is_excluded"))
    l, r = options.left_label, options.right_label
    pair = F.concat_ws("|", *KEYS)
    status = F.col("Status")
    excluded_rows = F.when(F.col("is_excluded"), F.col("left_rows") + F.col("right_rows"))

    def entry(condition: Column, level: str, message: Column, n: Column | None = None) -> Column:
        return F.when(condition, F.struct(
            F.lit(level).alias("level"), message.alias("message"),
            (F.lit(1) if n is None else n).cast("long").alias("occurrences"),
        ))

    reportable = ~F.col("is_skipped")
    per_key = [
        entry(_usable_left() & (F.col("right_rows") == 0), "WARN", F.concat(F.lit(f"Key missing in {r}: "), pair)),
        entry((status == fixed.DATA_ERROR) & reportable & F.col("is_blank_key"), "WARN",
              F.concat(F.lit("Key "), pair, F.lit(" has missing CustomerDomainName or ProductId"))),
        entry((status == fixed.DATA_ERROR) & reportable & ~F.col("is_blank_key"), "WARN",
              F.concat(F.lit("Key "), pair, F.lit(" has an amount out of range"))),
        entry(status == options.missing_right, "WARN", F.concat(F.lit("Key "), pair, F.lit(f" missing in {r} results"))),
        entry(F.col("is_skipped"), "WARN", F.concat(F.lit("Key skipped or filtered: "), pair)),
    ]
    if not options.hide_right_only:
        per_key.append(entry(status == options.missing_left, "WARN",
                             F.concat(F.lit("Key "), pair, F.lit(f" missing in {l} results"))))
    # The outer form: the inner one would build all entries again in a filter on their number.
    log = keys.select(F.array_compact(F.array(*per_key)).alias("e")).select(F.inline_outer("e")).where("level IS NOT NULL")

    tenants = (
        keys.where("is_excluded").groupBy(KEYS[0]).agg(F.sum(excluded_rows).alias("occurrences"))
        .select(F.lit("WARN").alias("level"),
                F.concat(F.lit("Excluded tenant "), F.col(KEYS[0])).alias("message"), "occurrences")
    )
    matched = overlap_sample(keys).select(
        F.lit("INFO").alias("level"), F.concat(F.lit("Key matched: "), pair).alias("message"),
        F.lit(1).cast("long").alias("occurrences"))
    repeated = duplicate_sample(keys).select(
        "level",
        F.concat(F.lit("Duplicate "), pair, F.lit(" appears "), F.col("n").cast("string"), F.lit(" times"))
        .alias("message"),
        F.lit(1).cast("long").alias("occurrences"))

    grouped = ~F.col("is_excluded")
    totals = keys.agg(
        F.count_if(_usable_left()).alias("lk"), F.count_if(_usable_right()).alias("rk"),
        F.count_if(_usable_left() & (F.col("right_rows") > 0)).alias("both"),
        F.count_if(_usable_left() & (F.col("left_rows") > 1)).alias("dup"),
        F.count_if(grouped & (F.col("left_rows") > 0)).alias("lg"),
        F.count_if(grouped & (F.col("right_rows") > 0)).alias("rg"),
    )
    always = F.lit(True)
    lines = [
        entry(always, "INFO", F.format_string(f"{l} unique keys: %d", "lk")),
        entry(always, "INFO", F.format_string(f"{r} unique keys: %d", "rk")),
        entry(always, "INFO", F.format_string("Overlap: %d.", "both")),
        entry(F.col("dup") > 0, "WARN", F.format_string(f"Duplicate {l} keys: %d", "dup")),
        entry(always, "INFO", F.format_string(f"Aggregated {l} keys: %d; {r} keys: %d", "lg", "rg")),
    ]
    for part in (tenants, matched, repeated,
                 totals.select(F.explode(F.array_compact(F.array(*lines))).alias("e")).select("e.*")):
        log = log.unionByName(part)
    same = None if left is None or right is None else partner_condition(left, right)
    if same is not None:
        warning = keys.sparkSession.range(1).where(~same).select(
            F.lit("WARN").alias("level"),
            F.lit("PartnerId mismatch between files - skipping filter.").alias("message"),
            F.lit(1).cast("long").alias("occurrences"))
        log = log.unionByName(warning)
    return log

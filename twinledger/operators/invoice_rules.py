"""Invoice rules over one feed: one narrow pass, no shuffle except for the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import dates as dt
from ..functions import numbers as num
from ..functions import text as tx
from ..options import DEFAULTS, Options
from .findings import collect_findings, rule_finding
from .schema import ROW

SEVERITY = {"days": "High", "partner_discount": "High", "hierarchy": "Low", "pricing": "Low"}


def _inputs(df: DataFrame) -> DataFrame:
    """The rule inputs, parsed once each."""
    start = dt.date_or_lowest(df, tx.first_found(df, ("ChargeStartDate",)) or "ValidFrom")
    end = dt.date_or_lowest(df, tx.first_found(df, ("ChargeEndDate",)) or "ValidTo")
    days = tx.find(df, "EffectiveDays")
    msrp = tx.first_found(df, ("MSRP",)) or "MSRPPrice"
    return tx.with_once(df, {
        "_days": dt.inclusive_days(start, end),
        "_effective": F.lit(0) if days is None else num.whole_or_zero(tx.cell(df, days)),
        "_msrp": num.rule_amount(df, msrp),
        "_partner": num.rule_amount(df, "PartnerDiscountPercentage"),
        "_customer": num.rule_amount(df, "CustomerDiscountPercentage"),
        "_total": num.rule_amount(df, "Total"),
        "_subtotal": num.rule_amount(df, "CustomerSubtotal"),
    })


_INPUTS = ("_days", "_effective", "_msrp", "_partner", "_customer", "_total", "_subtotal")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _checks(options: Options) -> dict[str, Column]:
    """Message of each rule where it is broken, else NULL."""
    days, effective, msrp, partner, customer, total, subtotal = (F.col(n) for n in _INPUTS)
    low, high = F.lit(options.min_partner_discount), F.lit(options.max_partner_discount)
    rounded = F.round(partner, 1)
    percent = num.short(partner)
    full_discount = customer >= 100
    return {
        "days": F.when(
            days != effective,
            _text("Mismatch: Expected EffectiveDays is ", days.cast("string"), " days, but found ",
                  effective.cast("string"), " days."),
        ),
        "partner_discount": F.when(
            msrp > F.lit(options.msrp_floor),
            F.when(
                partner <= 0,
                _text("Invalid: MSRP (", num.short(msrp), f") is greater than {options.msrp_floor.normalize():f}, but PartnerDiscountPercentage is ",
                      percent, "%."),
            ).when(
                (rounded < low) | (rounded > high),
                _text("Invalid: PartnerDiscountPercentage (", percent, "%) is not between ", num.short(low),
                      "% and ", num.short(high), "%."),
            ),
        ),
        "hierarchy": F.when(
            ~full_discount & (partner < customer),
            _text("Invalid: PartnerDiscountPercentage (", percent, "%) is less than CustomerDiscountPercentage (",
                  num.short(customer), "%)."),
        ),
        "pricing": F.when(
            ~((subtotal == 0) & full_discount) & (F.abs(total) > F.abs(subtotal)),
            _text("Invalid: PartnerTotal (", num.short(total), ") is greater than CustomerSubTotal (",
                  num.short(subtotal), ")."),
        ),
    }


def validated(df: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Every row with the four message columns, NULL where the rule holds."""
    messages = {fixed.INVOICE_CHECKS[rule]: message for rule, message in _checks(options).items()}
    return tx.with_once(_inputs(df), messages).drop(*_INPUTS)


def invalid_rows(df: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Rows breaking at least one rule."""
    broken = F.coalesce(*[tx.column(df, c) for c in fixed.INVOICE_CHECKS.values()])
    return validated(df, options).where(broken.isNotNull())


def violations(df: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One row per broken rule: rule column, severity, message."""
    broken = [
        F.when(tx.column(df, name).isNotNull(), F.struct(
            F.lit(name).alias("check"), F.lit(SEVERITY[rule]).alias("severity"),
            tx.column(df, name).alias("message")))
        for rule, name in fixed.INVOICE_CHECKS.items()
    ]
    return (
        validated(df, options)
        .select(F.array_compact(F.array(*broken)).alias("v"))
        # The outer form: below the inner one the messages would be built again in a filter on the array's size.
        .select(F.inline_outer("v")).where("check IS NOT NULL")
    )


def severity_counts(df: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One row: broken rules by severity, and the summary line."""
    def count(severity: str) -> Column:
        parts = [
            F.count(tx.column(df, fixed.INVOICE_CHECKS[rule])) for rule, s in SEVERITY.items() if s == severity
        ]
        return sum(parts[1:], parts[0])

    counts = validated(df, options).agg(count("High").alias("high"), count("Low").alias("low"))
    return counts.withColumn("summary", F.format_string("High: %d  Low: %d", "high", "low"))


def with_severity(invalid: DataFrame) -> DataFrame:
    """Adds the severity of the gravest broken rule of a failing row."""
    high = F.coalesce(*[tx.column(invalid, fixed.INVOICE_CHECKS[r]) for r, s in SEVERITY.items() if s == "High"])
    return invalid.withColumn("severity", F.when(high.isNotNull(), "High").otherwise("Low"))


def high_priority_only(invalid: DataFrame) -> DataFrame:
    return with_severity(invalid).where("severity = 'High'")


def skip_findings(df: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Warnings about checks skipped because the customer discount is 100 % or more."""
    customer, subtotal = F.col("_customer"), F.col("_subtotal")
    common = {"file_name": fixed.VALIDATED_FEED_NAME, "row": F.col(ROW) if ROW in df.columns else None}
    return collect_findings(_inputs(df), [
        rule_finding(
            customer >= 100, level="Warning", rule="I3w", column="customerDiscountPercentage",
            description="Customer at 100% discount – hierarchy check skipped.", raw=num.plain(customer), **common,
        ),
        rule_finding(
            (subtotal == 0) & (customer >= 100), level="Warning", rule="I4w", column="customerSubtotal",
            description="Customer billed $0 due to 100% discount – consistency check skipped.",
            raw=num.plain(subtotal), **common,
        ),
    ])

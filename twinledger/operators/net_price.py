"""Net quantity and price comparison: credits and debits of a key cancel out first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import numbers as num
from ..functions import text as tx
from ..options import DEFAULTS, Options
from .business_key import KEYS
from .filters import drop_usage_plan_any_case

_FALLBACK = {"CustomerDomainName": "CustomerName", "ProductId": "PartNumber"}


def _key(df: DataFrame, name: str) -> Column:
    return tx.key(F.coalesce(tx.nonblank(tx.cell(df, name)), tx.cell(df, _FALLBACK[name])))


def _one_side(df: DataFrame, is_left: bool, charge: Column) -> DataFrame:
    quantity, subtotal = num.amount(df, "Quantity"), num.amount(df, "Subtotal")
    none = F.lit(None).cast(num.AMOUNT)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return df.select(
        *[_key(df, k).alias(k) for k in KEYS],
        charge.alias("ChargeType"),
        (one if is_left else zero).alias("left_rows"),
        (zero if is_left else one).alias("right_rows"),
        (quantity if is_left else none).alias("lq"),
        (subtotal if is_left else none).alias("ls"),
        (none if is_left else quantity).alias("rq"),
        (none if is_left else subtotal).alias("rs"),
    )


def net_price_mismatches(
    left: DataFrame, right: DataFrame, options: Options = DEFAULTS, left_shape: bool = False
) -> DataFrame:
    """Keys on both sides whose summed quantity or subtotal differs.

    Charge types of the left rows are listed, sorted. With ``left_shape`` the
    other left columns are carried as NULL, as in a row of the left feed.
    """
    left = drop_usage_plan_any_case(left, fixed.USAGE_PLAN_LEFT_COLUMN)
    right = drop_usage_plan_any_case(right, fixed.USAGE_PLAN_RIGHT_COLUMN)
    has_charge = tx.find(left, "ChargeType") is not None
    no_charge = F.lit(None).cast("string")
    both = _one_side(left, True, tx.cell(left, "ChargeType") if has_charge else no_charge).unionByName(
        _one_side(right, False, no_charge)
    )
    sums = [F.sum(c).alias(c) for c in ("left_rows", "right_rows")] + [num.wide_sum(F.col(c)).alias(c) for c in ("lq", "ls", "rq", "rs")]
    listed = []
    if has_charge:
        # Totals per charge type first: the list below then sees each charge type once,
        # and a hot key is spread over its charge types.
        both = both.groupBy(*KEYS, "ChargeType").agg(*sums)
        listed = [F.array_join(F.sort_array(F.collect_list("ChargeType")), ", ").alias("ChargeType")]
    totals = both.groupBy(*KEYS).agg(*sums, *listed).where("left_rows > 0 AND right_rows > 0")
    lq, ls, rq, rs = (F.coalesce(F.col(c), F.lit(0)).cast(num.TOTAL) for c in ("lq", "ls", "rq", "rs"))
    tolerance = F.lit(options.numeric_tolerance)
    l, r = options.left_prefix, options.right_prefix
    quantity, price = num.difference(lq, rq), num.difference(ls, rs)
    result = totals.where((F.abs(quantity) > tolerance) | (F.abs(price) > tolerance)).select(
        *KEYS,
        *(["ChargeType"] if has_charge else []),
        lq.alias(f"{l}Quantity"), rq.alias(f"{r}Quantity"),
        ls.alias(f"{l}Subtotal"), rs.alias(f"{r}Subtotal"),
        quantity.try_cast(num.TOTAL).alias("QuantityDiff"),
        price.try_cast(num.TOTAL).alias("PriceDiff"),
    )
    if not left_shape:
        return result
    filled = {c.lower() for c in (*KEYS, "ChargeType")}
    added = [c for c in result.columns if c.lower() not in filled]
    return result.select(
        *[F.col(n) if n.lower() in filled else F.lit(None).cast(left.schema[n].dataType).alias(n)
          for n in left.columns],
        *added,
    )

"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import text as tx
from ..options import DEFAULTS, Options


def is_usage_plan(df: DataFrame, name: str) -> Column:
    return tx.cell(df, name) == fixed.USAGE_PLAN


def drop_usage_plan(df: DataFrame, name: str) -> DataFrame:
    """Drops usage-plan rows by exact text."""
    return df.where(~is_usage_plan(df, name))


def drop_usage_plan_any_case(df: DataFrame, name: str) -> DataFrame:
    if tx.find(df, name) is None:
        return df
    return df.where(F.upper(tx.cell(df, name)) != fixed.USAGE_PLAN.upper())


def is_excluded(tenant: Column, options: Options = DEFAULTS) -> Column:
    if not options.excluded_tenants:
        return F.lit(False)
    return tx.key(tenant).isin([t.strip().upper() for t in options.excluded_tenants])


def _single_partner(df: DataFrame) -> DataFrame:
    """One row: the only non-blank partner id of the feed, or NULL if there are none or several."""
    ids = F.upper(tx.nonblank(tx.cell(df, "PartnerId")))
    low, high = F.min(ids), F.max(ids)
    return df.agg(F.when(low == high, low).alias("id"))


def partner_condition(left: DataFrame, right: DataFrame) -> Column | None:
    """Whether both feeds hold one and the same partner; None if a side has no PartnerId column.

    Smallest equals largest replaces a distinct count, so each side is a
    map-side combined aggregate of one row, read as a scalar subquery.
    """
    if tx.find(left, "PartnerId") is None or tx.find(right, "PartnerId") is None:
        return None
    return F.coalesce(
        _single_partner(left).scalar() == _single_partner(right).scalar(), F.lit(False)
    )


def slice_partner(left: DataFrame, right: DataFrame) -> DataFrame:
    """Right rows of the one shared partner; all rows if the feeds do not share exactly one."""
    same = partner_condition(left, right)
    if same is None:
        return right
    # The slice only removes right rows with a blank id: all others carry the shared one.
    return right.where(~same | ~tx.is_blank(tx.cell(right, "PartnerId")))

"""Comparison and validation runs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from ..operators import business_key as bk
from ..operators import invoice_rules as ir
from ..operators.net_price import net_price_mismatches
from ..operators.schema import prepare_side
from ..options import DEFAULTS, Options


class Comparison(NamedTuple):
    """Lazy results of a comparison; all but the price pass read ``keys``.

    Persist ``keys`` to read several results without grouping again.
    """

    keys: DataFrame
    result: DataFrame
    price_mismatches: DataFrame
    summary: DataFrame
    diagnostics: DataFrame
    log: DataFrame


def compare(left: DataFrame, right: DataFrame, options: Options = DEFAULTS) -> Comparison:
    """Both passes over the same feeds: totals per business key, then net prices.

    The price pass reads the prepared feeds without the partner slice.
    """
    keys = bk.compare_keys(left, right, options)
    prepared_left, prepared_right = prepare_side(left), prepare_side(right)
    return Comparison(
        keys=keys,
        result=bk.result_rows(keys, options),
        price_mismatches=net_price_mismatches(prepared_left, prepared_right, options),
        summary=bk.summarise(keys, options),
        diagnostics=bk.key_diagnostics(keys),
        log=bk.run_log(keys, options, prepared_left, prepared_right),
    )


class Validation(NamedTuple):
    invalid: DataFrame
    counts: DataFrame
    findings: DataFrame


def validate(feed: DataFrame, options: Options = DEFAULTS) -> Validation:
    return Validation(
        invalid=ir.invalid_rows(feed, options),
        counts=ir.severity_counts(feed, options),
        findings=ir.skip_findings(feed, options),
    )

"""Run options: plain driver-side configuration, no data."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from . import fixed_values as fixed


@dataclass(frozen=True)
class Options:
    # Tolerances. The separate amount and quantity tolerances default to the numeric one.
    numeric_tolerance: Decimal = Decimal("0.01")
    amount_tolerance: Decimal | None = None
    quantity_tolerance: Decimal | None = None
    per_day_unit_tolerance: Decimal = Decimal("0.05")
    date_tolerance_days: int = 0
    # Texts this many edits apart count as equal; None compares them exactly.
    text_distance: int | None = None

    # Findings.
    blank_threshold: Decimal = Decimal("0.1")
    max_detailed_rows: int = 5

    # Business-key comparison.
    excluded_tenants: tuple[str, ...] = ()
    drop_excluded: bool = False
    hide_right_only: bool = False
    # An absolute difference of totals from this amount on is marked high priority; None marks nothing.
    high_priority_threshold: Decimal | None = None

    # Invoice rules.
    msrp_floor: Decimal = Decimal("5")
    min_partner_discount: Decimal = Decimal("18.0")
    max_partner_discount: Decimal = Decimal("20.1")

    # Labels.
    left_label: str = fixed.LEFT_LABEL
    right_label: str = fixed.RIGHT_LABEL
    left_prefix: str = fixed.LEFT_PREFIX
    right_prefix: str = fixed.RIGHT_PREFIX

    # Ingest.
    composite_keys: tuple[str, ...] = fixed.COMPOSITE_KEYS
    column_maps: dict = field(default_factory=lambda: fixed.COLUMN_MAPS)
    keep_extras: bool = False
    multi_line: bool = False  # take every file for one whose quoted cells hold line breaks

    @property
    def missing_right(self) -> str:
        return f"Missing in {self.right_label}"

    @property
    def missing_left(self) -> str:
        return f"Missing in {self.left_label}"

    def tolerance_for(self, metric: str) -> Decimal:
        special = self.quantity_tolerance if metric == "Quantity" else self.amount_tolerance
        return self.numeric_tolerance if special is None else special


DEFAULTS = Options()

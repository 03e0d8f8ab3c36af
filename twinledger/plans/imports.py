"""Feed imports: scan, clean, map, derive, drop."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..functions import dates as dt
from ..functions import numbers as num
from ..functions import text as tx
from ..operators import schema as sc
from ..operators.data_quality import ROWS, blank_counts, blank_findings_of, quality_findings, row_rules
from ..operators.filters import drop_usage_plan, is_usage_plan
from ..operators.findings import FINDING_TYPE, NOTE_TYPE, collect_findings, found_by, of_notes, rule_finding
from ..operators.ordinals import PLACE, block_offsets, with_row_numbers
from ..options import DEFAULTS, Options
from ..sources.feeds import detect_source, scan_places, with_file_name
from ..staging import written


class Feed(NamedTuple):
    """An imported feed: three lazy frames over one table, or over the frame that was given."""

    rows: DataFrame
    findings: DataFrame
    rejects: DataFrame


def _marks(df: DataFrame) -> list[str]:
    return [c for c in sc.MARKS if c in df.columns]


class _Cells(NamedTuple):
    """Clean cells with what was read of each date and number column, NULL where unreadable."""

    frame: DataFrame  # with _ODD
    names: list[str]  # the feed's columns and marks
    read: dict[str, str]  # column to the one with what was read of it


#: 0 for a row of printable ASCII, else 1, and 2 more if it has characters to be dropped, 4 more if it has line breaks or tabs.
_ODD = "_odd"


def _cleaned(raw: DataFrame, filtered: bool = True) -> _Cells:
    """Cells are cleaned, and then read, in projections of their own: later steps use each several times.

    Whether a row has any character to be dropped, or any line break or tab, is asked once of all its
    cells; their separator is neither and keeps broken characters apart. Rows of printable ASCII, as most are,
    have neither, and only blanks around their cells. ``filtered`` tells that filters may follow, which have to stay above.
    """
    marks, names = _marks(raw), raw.columns
    feed = [n for n in names if n not in marks]
    row = F.concat_ws("|", *[tx.cell(raw, n) for n in feed]) if feed else F.lit("")
    kind = F.when(tx.is_printable_ascii(row), 0).otherwise(
        F.lit(1) + F.when(tx.has_control(row), 2).otherwise(0) + F.when(tx.has_break(row), 4).otherwise(0))
    seen = tx.with_once(raw, {_ODD: kind}) if filtered else raw.withColumn(_ODD, kind)

    def cleaned(name: str) -> Column:
        c = tx.cell(seen, name)
        return F.when(F.col(_ODD) == 0, F.trim(c)).when(F.col(_ODD).isin(3, 7), tx.clean(c)).otherwise(tx.strip(c)).alias(name)

    cells = seen.select(*[tx.column(seen, n) if n in marks else cleaned(n) for n in names], _ODD)
    read = {n: f"_read_{i}" for i, n in enumerate(feed) if sc.is_date_name(n) or sc.is_number_name(n)}

    def read_of(name: str) -> Column:
        c = tx.column(cells, name)
        return dt.date_text(c, stripped=True) if sc.is_date_name(name) else num.number_text(c)

    return _Cells(cells.select("*", *[read_of(n).alias(alias) for n, alias in read.items()]), names, read)


def _normalised(cells: _Cells) -> list[Column]:
    """Each cell in the form of its column's class: date, number or text. Unreadable cells stay."""
    marks = _marks(cells.frame)

    def value(name: str):
        c = tx.column(cells.frame, name)
        if name in cells.read:
            return F.coalesce(F.col(cells.read[name]), c)
        text = tx.collapse_spaces(c, F.col(_ODD) >= 4)
        keep_zeros = "id" in name.lower() or "sku" in name.lower()
        return text if keep_zeros else tx.strip_leading_zeros(text)

    return [tx.column(cells.frame, n) if n in marks else value(n).alias(n) for n in cells.names]


def normalise(raw: DataFrame) -> DataFrame:
    """Cleans every cell by its column's class: date, number or text. Unreadable cells stay."""
    cells = _cleaned(raw)
    return cells.frame.select(*_normalised(cells))


def _cell_rules(cells: _Cells, file_name: str, kind: T.StructType = FINDING_TYPE) -> list[Column]:
    """Findings about clean cells: unreadable dates and numbers, and amounts too large to be compared."""
    common = {
        "row": F.col(sc.ROW) if sc.ROW in cells.names else None,
        "file_name": F.col(sc.FILE) if sc.FILE in cells.names else file_name,
        "kind": kind,
    }
    rules = []
    for name, read in cells.read.items():
        c, value = tx.column(cells.frame, name), F.col(read)
        if sc.is_date_name(name):
            rules.append(rule_finding(
                value.isNull() & (c != ""), level="Error", rule="Q7", column=name, raw=c,
                description=F.concat(F.lit("Invalid date '"), c, F.lit("' – unable to parse.")), **common))
        elif sc.is_number_name(name):
            # What was read is NULL for unreadable numbers, and for some with an exponent that are out of range.
            rules.append(rule_finding(
                value.isNull() & (c != "") & num.is_unreadable_number(c), level="Error", rule="Q7", column=name, raw=c,
                description=F.concat(F.lit("Invalid numeric '"), c, F.lit("' – unable to parse.")), **common))
            # Twelve characters without an exponent always fit.
            rules.append(rule_finding(
                ((F.length(c) > 12) | num.has_exponent(c)) & value.try_cast(num.AMOUNT).isNull()
                & (value.isNotNull() | ~num.is_unreadable_number(c)),
                level="Error", rule="Q7", column=name, raw=c,
                description=F.concat(F.lit("Number '"), c, F.lit("' is out of range.")), **common))
    return rules


def normalise_findings(raw: DataFrame, file_name: str = "") -> DataFrame:
    """Dates and numbers that could not be read, and amounts too large to be compared."""
    cells = _cleaned(raw)
    return collect_findings(cells.frame, _cell_rules(cells, file_name))


def _keep_keyed(df: DataFrame, kind: str, options: Options) -> tuple[DataFrame, DataFrame]:
    keyed = sc.has_key(df, kind, options)
    return df.where(keyed), df.where(~keyed).select(*_reject_columns(), *_marks(df))


def _reject_columns() -> list[Column]:
    return [F.lit("WARN").alias("level"), F.lit("Row skipped: missing CustomerDomainName or ProductId").alias("message")]


def canonical_right(normalised: DataFrame, options: Options = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The vendor feed from cleaned cells: mapped, usage-plan rows dropped, terms derived."""
    kept, rejects = _keep_keyed(normalised, fixed.MICROSOFT, options)
    rows = _mapped(kept, fixed.MICROSOFT, options)
    return drop_usage_plan(rows, fixed.USAGE_PLAN_RIGHT_COLUMN), rejects


def canonical_left(
    normalised: DataFrame, options: Options = DEFAULTS, kind: str = fixed.PARTNER
) -> tuple[DataFrame, DataFrame]:
    """The company's own feed from cleaned cells: mapped, renamed, SKU zeros and usage-plan rows dropped."""
    options = _with_old_names(normalised, options, kind)
    kept, rejects = _keep_keyed(normalised, kind, options)
    return drop_usage_plan(_mapped(kept, kind, options), fixed.USAGE_PLAN_LEFT_COLUMN), rejects


def _mapped(normalised: DataFrame, kind: str, options: Options, done: Collection[str] = ()) -> DataFrame:
    """All rows of a feed in the canonical columns of its kind, with their derived values."""
    rows = sc.normalise_mapped(sc.map_canonical(normalised, kind, options), options, done)
    if kind == fixed.MICROSOFT:
        return sc.reorder(sc.split_term(rows), fixed.RIGHT_LEADING_COLUMNS)
    rows = rows.withColumn("SkuId", tx.strip_leading_zeros(F.col("SkuId")))
    return sc.reorder(sc.ensure_columns(rows, fixed.CANONICAL_COLUMNS), fixed.LEADING_COLUMNS)


def _with_old_names(raw: DataFrame, options: Options, kind: str) -> Options:
    """A column the raw feed still has under its old name replaces the mapped one."""
    old = {new: name for name, new in fixed.LEFT_RENAMES if tx.find(raw, name) is not None}
    if not old:
        return options
    maps = {**options.column_maps, kind: {**options.column_maps[kind], **old}}
    return replace(options, column_maps=maps)


def import_frame(
    raw: DataFrame, kind: str, options: Options = DEFAULTS, file_name: str = "", check: bool = True
) -> Feed:
    """Imports an already loaded feed of text columns."""
    right = kind == fixed.MICROSOFT
    if check:
        _checked(raw, kind, options)
    normalised = normalise(raw)
    rows, rejects = canonical_right(normalised, options) if right else canonical_left(normalised, options, kind)
    findings = normalise_findings(raw, file_name).unionByName(quality_findings(normalised, file_name, options))
    return Feed(rows, findings, rejects)


def _checked(raw: DataFrame, kind: str, options: Options) -> None:
    right = kind == fixed.MICROSOFT
    label = fixed.RIGHT_FEED_NAME if right else fixed.LEFT_FEED_NAME
    names = fixed.REQUIRED_RIGHT if right else fixed.REQUIRED_LEFT
    sc.require_mapped_columns(raw, label, names, options.column_maps[kind], () if right else fixed.LEFT_RENAMES)


def in_one_pass(raw: DataFrame, kind: str, options: Options = DEFAULTS, seen: Observation | None = None) -> DataFrame:
    """Every raw row once: its canonical columns, all its findings, whether it has a key and whether it is kept.

    ``seen`` observes the counts that the whole-feed rules need while the rows pass.
    """
    cells = _cleaned(raw, filtered=False)
    found = found_by(_cell_rules(cells, "", NOTE_TYPE), NOTE_TYPE)
    noted = cells.frame.select(*_normalised(cells), (F.col(_ODD) == 0).alias(sc.PLAIN), found.alias(sc.FOUND))
    if kind != fixed.MICROSOFT:
        options = _with_old_names(noted, options, kind)
    if seen is not None:
        noted = noted.observe(seen, *blank_counts(noted))
    parsed, rules = row_rules(noted, kind=NOTE_TYPE)
    noted = parsed.select(
        *[tx.column(parsed, n) for n in noted.columns if n != sc.FOUND], F.concat(sc.FOUND, found_by(rules, NOTE_TYPE)).alias(sc.FOUND))
    noted = noted.withColumn(sc.KEYED, sc.has_key(noted, kind, options))
    rows = _mapped(noted, kind, options, sc.in_its_form(noted, kind, options))
    plan = fixed.USAGE_PLAN_RIGHT_COLUMN if kind == fixed.MICROSOFT else fixed.USAGE_PLAN_LEFT_COLUMN
    return rows.withColumn(sc.KEPT, F.col(sc.KEYED) & ~is_usage_plan(rows, plan)).drop(sc.PLAIN)


def import_feed(
    spark: SparkSession, path: str, kind: str | None = None, options: Options = DEFAULTS, check: bool = True
) -> Feed:
    """Imports a file (its kind detected by name unless given); an empty feed is an error.

    The feed is read and evaluated once. Its rows are written to the shared folder with their findings
    and flags, while the counts for the whole-feed rules are observed; the three frames read that table.
    Row numbers meet only the rows that show them.
    """
    kind = kind or detect_source(path)
    raw = scan_places(spark, path, options)
    empty = ValueError(f"The selected {kind} file contains no rows.")
    if check:
        try:
            _checked(raw, kind, options)
        except sc.MissingColumns as missing:  # an empty feed is the plainer message
            raise (empty if raw.isEmpty() else missing) from None
    seen = Observation()
    # What a place tells is not written, nor what is blank in every row.
    whole = in_one_pass(raw.drop(sc.FILE), kind, options, seen)
    blank = sc.unfilled(raw, kind, _with_old_names(raw, options, kind) if kind != fixed.MICROSOFT else options)
    staged = written(whole.drop(*blank), "import")
    if not seen.get[ROWS]:
        raise empty
    offsets = block_offsets(staged)
    shown = [c for c in whole.columns if c not in (PLACE, sc.FOUND, sc.KEYED, sc.KEPT)] + [sc.FILE]
    staged = with_file_name(staged.withColumns({n: F.lit("") for n in blank}))
    kept = staged.where(sc.KEPT).select(*[tx.column(staged, c) for c in shown], PLACE)
    rejects = staged.where(~F.col(sc.KEYED)).select(*_reject_columns(), sc.FILE, PLACE)
    notes = with_row_numbers(staged.select(PLACE, sc.FILE, F.inline(sc.FOUND)), offsets)
    found = of_notes(notes, F.col(sc.ROW), F.col(sc.FILE))
    rates = blank_findings_of(spark, raw, seen.get, path.rsplit("/", 1)[-1], options)
    return Feed(with_row_numbers(kept, offsets), found.unionByName(rates), with_row_numbers(rejects, offsets))


def import_right(spark: SparkSession, path: str, options: Options = DEFAULTS) -> Feed:
    return import_feed(spark, path, fixed.MICROSOFT, options, check=False)


def import_left(spark: SparkSession, path: str, options: Options = DEFAULTS) -> Feed:
    return import_feed(spark, path, fixed.PARTNER, options, check=False)


def import_legacy(spark: SparkSession, path: str, options: Options = DEFAULTS) -> DataFrame:
    """A file, folder or pattern in the older feed layout, as its rows; a row's order in its file is not kept."""
    raw = scan_places(spark, path, options)
    return sc.legacy_feed(raw.drop(PLACE, sc.FILE))


def row_count(rows: DataFrame) -> DataFrame:
    """Rows per imported file."""
    if sc.FILE in rows.columns:
        return rows.groupBy(F.col(sc.FILE).alias("file_name")).agg(F.count(F.lit(1)).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("n"))

"""Schema and projection operators: renames, aliases, canonical mapping, derivations."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import dates as dt
from ..functions import numbers as num
from ..functions import text as tx
from ..functions.arithmetic import arithmetic
from ..options import DEFAULTS, Options
from .findings import FINDING_TYPE
from .ordinals import PLACE

ROW = "_row"
FILE = "_file"
FOUND = "_found"  # findings of the row so far
KEYED = "_keyed"  # whether the row has its key
KEPT = "_kept"  # whether it also passes the feed's filters
PLAIN = "_plain"  # whether all cells of the row are printable ASCII, without line breaks and the like
MARKS = (ROW, FILE, PLACE, FOUND, KEYED, KEPT, PLAIN)


class MissingColumns(ValueError):
    """A feed lacks required columns; ``findings`` has one entry per column."""

    def __init__(self, label: str, names: Sequence[str]):
        super().__init__(f"{label} is missing required columns: {', '.join(names)}")
        self.label = label
        self.names = list(names)

    def findings(self, spark: SparkSession) -> DataFrame:
        rows = [
            ("Error", "P1", -1, name,
             f"The expected column '{name}' was not found in the {self.label} file. "
             "Please check your CSV for missing or renamed columns.",
             "", self.label, "", False)
            for name in self.names
        ]
        return spark.createDataFrame(rows, FINDING_TYPE)


def require_columns(df: DataFrame, label: str, names: Sequence[str]) -> None:
    missing = [n for n in names if tx.find(df, n) is None]
    if missing:
        raise MissingColumns(label, missing)


def rule_sources(rule) -> list[str]:
    """Raw columns a map rule reads."""
    if isinstance(rule, str):
        return [rule]
    return [name for name in rule if name not in ("*", "+")]


def require_mapped_columns(
    raw: DataFrame, label: str, names: Sequence[str], column_map: Mapping[str, object],
    renames: Sequence[tuple[str, str]] = (),
) -> None:
    """Checks a raw header: a canonical column is there if any column it is mapped from is."""
    also = {}
    for old, new in renames:
        also.setdefault(new, []).append(old)
    missing = [
        n for n in names
        if tx.first_found(raw, [n, *rule_sources(column_map.get(n, ())), *also.get(n, [])]) is None
    ]
    if missing:
        raise MissingColumns(label, missing)


def ensure_columns(df: DataFrame, names: Sequence[str], value: Column | None = None) -> DataFrame:
    missing = {n: F.lit("") if value is None else value for n in names if tx.find(df, n) is None}
    return df.withColumns(missing) if missing else df


def rename_replace(df: DataFrame, renames: Sequence[tuple[str, str]]) -> DataFrame:
    """Where the old column exists it takes the new name, replacing any column of that name."""
    for old, new in renames:
        found, replaced = tx.find(df, old), tx.find(df, new)
        if found is None:
            continue
        if replaced is not None:
            df = df.drop(tx.column(df, replaced))
        df = df.withColumnRenamed(found, new)
    return df


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    lead = [n for n in (tx.find(df, x) for x in first) if n is not None]
    return df.select([tx.column(df, n) for n in lead + [c for c in df.columns if c not in lead]])


def hide_columns(df: DataFrame, names: Sequence[str] = fixed.HIDDEN_COLUMNS) -> DataFrame:
    return df.drop(*[c for c in (tx.find(df, n) for n in names) if c is not None])


def merge_aliases(df: DataFrame, aliases: Sequence[tuple[str, str]] = fixed.ALIASES) -> DataFrame:
    """Folds alias columns into their targets, first non-blank wins, and drops them."""
    sources: dict[str, list[str]] = {}
    for alias, target in aliases:
        found = tx.find(df, alias)
        if found is not None:
            sources.setdefault(target, []).append(found)
    merged, used = {}, set()
    for target, names in sources.items():
        own = tx.find(df, target)
        names = names if own is None else [own, *names]
        used.update(names)
        if len(names) == 1:
            merged[target] = tx.column(df, names[0])
        elif len({df.schema[n].dataType for n in names}) == 1 and not tx.is_text(df, names[0]):
            merged[target] = F.coalesce(*[tx.column(df, n) for n in names])
        else:
            merged[target] = F.coalesce(*[tx.nonblank(tx.cell(df, n)) for n in names], F.lit(""))
    if not merged:
        return df
    keep = [tx.column(df, c) for c in df.columns if c not in used]
    return df.select(*keep, *[value.alias(target) for target, value in merged.items()])


def normalise_keys(df: DataFrame) -> DataFrame:
    """Upper-cases and trims key columns; the charge start date becomes ISO text."""
    changed = {n: tx.key(tx.cell(df, n)) for n in fixed.UPPER_KEYS if tx.find(df, n) is not None}
    start = tx.find(df, "ChargeStartDate")
    if start is not None:
        c = tx.cell(df, start)
        changed[start] = F.coalesce(dt.date_text(c), tx.strip(c))
    return df.withColumns(changed)


def prepare_side(df: DataFrame) -> DataFrame:
    """Makes a feed comparable: aliases merged, compared columns present, keys normalised."""
    return normalise_keys(ensure_columns(merge_aliases(df), fixed.COMPARED_COLUMNS))


# --- Canonical mapping -------------------------------------------------------------


def _first_nonempty(df: DataFrame, names: Sequence[str]) -> Column:
    return F.coalesce(*[F.nullif(tx.cell(df, n), F.lit("")) for n in names], F.lit(""))


def _resolve(df: DataFrame, rule, built: Mapping[str, Column]) -> Column:
    if isinstance(rule, str):
        if "{" in rule:
            def value_of(name: str) -> Column:
                earlier = next((n for n in fixed.CANONICAL_COLUMNS if n.lower() == name.lower()), None)
                if earlier is not None:
                    # A canonical column not built yet is still blank.
                    text = built.get(earlier)
                    return F.lit(0).cast(num.AMOUNT) if text is None else _zero_if_blank(text)
                return _zero_if_blank(tx.cell(df, name))
            return num.plain(arithmetic(rule, value_of))
        return tx.cell(df, rule)
    if len(rule) == 3 and rule[2] == "*":
        return num.plain(num.amount(df, rule[0]) * num.amount(df, rule[1]))
    if len(rule) == 4 and rule[2] == "+":
        return num.plain(num.amount(df, rule[0]) * num.amount(df, rule[1]) + num.amount(df, rule[3]))
    return _first_nonempty(df, rule)


def _zero_if_blank(c: Column) -> Column:
    """Amount of a template cell: blank is 0, unreadable NULL (which makes the whole rule 0)."""
    return F.when(tx.is_blank(c), F.lit(0).cast(num.AMOUNT)).otherwise(num.lenient_decimal(c))


def map_canonical(df: DataFrame, kind: str, options: Options = DEFAULTS) -> DataFrame:
    """One projection from a raw feed to the canonical columns of its source kind.

    Key parts left blank are filled from CustomerName and PartNumber. Row and
    file markers pass through, and other raw columns on request.
    """
    rules = options.column_maps[kind]
    built: dict[str, Column] = {}
    for name in fixed.CANONICAL_COLUMNS:
        built[name] = _resolve(df, rules[name], built) if rules.get(name) else F.lit("")
    built["CustomerDomainName"] = F.coalesce(
        tx.nonblank(built["CustomerDomainName"]), tx.cell(df, "CustomerName")
    )
    built["ProductId"] = F.coalesce(tx.nonblank(built["ProductId"]), tx.cell(df, "PartNumber"))
    passed = [m for m in MARKS if m in df.columns]
    if options.keep_extras:
        known = {n.lower() for n in fixed.CANONICAL_COLUMNS} | set(passed)
        passed += [c for c in df.columns if c.lower() not in known]
    return df.select(*[c.alias(n) for n, c in built.items()], *[tx.column(df, m) for m in passed])


def has_key(df: DataFrame, kind: str, options: Options = DEFAULTS) -> Column:
    """Whether a raw row has both key parts, directly or through their fallbacks.

    Asked of the raw columns, each read once: on the mapped ones the filter would
    be pushed down with several copies of their cleaning.
    """
    rules = options.column_maps[kind]

    def filled(name: str, fallback: str) -> Column:
        own = _resolve(df, rules[name], {}) if rules.get(name) else F.lit("")
        return ~tx.is_blank(F.concat(own, tx.cell(df, fallback)))

    return filled("CustomerDomainName", "CustomerName") & filled("ProductId", "PartNumber")


def is_date_name(name: str) -> bool:
    return name.lower().endswith(fixed.DATE_SUFFIXES)


def is_number_name(name: str) -> bool:
    return name.lower() in fixed.NUMERIC_NAMES or name.lower().endswith(fixed.NUMERIC_SUFFIXES)


def in_its_form(df: DataFrame, kind: str, options: Options = DEFAULTS) -> set[str]:
    """Canonical date and number columns that are mapped one to one from a raw column of the same class.

    Where the raw cells have been read once, reading these again would give the same text.
    """
    def same(name: str, rule) -> bool:
        if not isinstance(rule, str) or "{" in rule or tx.find(df, rule) is None:
            return False
        return is_date_name(rule) if is_date_name(name) else is_number_name(name) and is_number_name(rule) and not is_date_name(rule)

    return {n for n in fixed.CANONICAL_COLUMNS if same(n, options.column_maps[kind].get(n))}


def unfilled(df: DataFrame, kind: str, options: Options = DEFAULTS) -> list[str]:
    """Canonical columns that are blank in every row: no raw column fills them, and nothing is derived for them."""
    derived = ("CustomerDomainName", "ProductId", "Term", "BillingCycle")

    def blank(rule) -> bool:
        if isinstance(rule, str):
            return "{" not in rule and tx.find(df, rule) is None
        return not rule or not {"*", "+"} & set(rule) and tx.first_found(df, rule) is None

    return [n for n in fixed.CANONICAL_COLUMNS if n not in derived and blank(options.column_maps[kind].get(n))]


def normalise_mapped(df: DataFrame, options: Options = DEFAULTS, done: Collection[str] = ()) -> DataFrame:
    """Canonical text per column class: ISO dates, plain numbers, upper-case key columns.

    Keys that read as numbers take their plain form on either side, so zero-padded ones meet.
    ``done`` are columns that have their form already.
    """
    upper = {"customerdomainname", "productid", *[c.lower() for c in options.composite_keys]}

    def value(name: str) -> Column:
        c = tx.cell(df, name)
        if name in done:
            return c
        c = F.when(F.col(PLAIN), F.trim(c)).otherwise(tx.strip(c)) if PLAIN in df.columns else tx.strip(c)
        if is_date_name(name):
            return F.coalesce(dt.date_text(c, stripped=True), c)
        if is_number_name(name):
            return F.coalesce(num.lenient_number_text(c), c)
        return F.coalesce(F.when(num.may_be_number(c), num.lenient_number_text(c)), F.upper(c)) if name.lower() in upper else c

    return df.select(*[tx.column(df, n) if n in MARKS else value(n).alias(n) for n in df.columns])


def split_term(df: DataFrame) -> DataFrame:
    """Fills blank Term and BillingCycle from the commitment phrase."""
    phrase = tx.cell(df, "TermAndBillingCycle")
    no_frequency = tx.cell(df, "BillingFrequency") == ""
    term = cycle = None
    for text, new_term, new_cycle in fixed.TERMS:
        if isinstance(new_cycle, tuple):
            blank, other = new_cycle
            cycle_value = F.when(no_frequency, F.lit(blank)).otherwise(F.lit(other))
        else:
            cycle_value = F.lit(new_cycle)
        hit = phrase == text
        term = F.when(hit, F.lit(new_term)) if term is None else term.when(hit, F.lit(new_term))
        cycle = F.when(hit, cycle_value) if cycle is None else cycle.when(hit, cycle_value)
    other_term, other_cycle = fixed.OTHER_TERM
    derived = {"Term": term.otherwise(other_term), "BillingCycle": cycle.otherwise(other_cycle)}
    return df.withColumns(
        {n: F.coalesce(F.nullif(tx.cell(df, n), F.lit("")), c) for n, c in derived.items()}
    )


def legacy_feed(df: DataFrame) -> DataFrame:
    """The older feed layout: US dates, three renames, four stub columns, clean keys."""
    df = df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})
    dates = {}
    for name in fixed.LEGACY_DATES:
        found = tx.find(df, name)
        if found is not None:
            c = tx.cell(df, found)
            dates[found] = F.coalesce(F.date_format(dt.parse_timestamp(c), "MM/dd/yyyy"), c)
    df = rename_replace(df.withColumns(dates) if dates else df, fixed.LEGACY_RENAMES)
    df = ensure_columns(df, fixed.LEGACY_STUBS)
    keys = [tx.find(df, n) for n in fixed.LEGACY_KEYS]
    return df.withColumns({k: tx.clean_key(tx.cell(df, k)) for k in keys if k is not None})

"""Text columns: blanks, cleaning, keys, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed

WHITESPACE = " \t\r\n\f\u000b\u0085\u00a0"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    # A visible ASCII character in front settles it for nearly all cells.
    return c.isNull() | (((c < "!") | (c >= "\u007f")) & (strip(c) == ""))


def nonblank(c: Column) -> Column:
    """The value, or NULL where it is blank."""
    return F.when(~is_blank(c), c)


def clean(c: Column) -> Column:
    """Drops control characters other than CR, LF and TAB, then trims."""
    return strip(F.regexp_replace(c, r"[\p{C}&&[^\r\n\t]]", ""))


def has_control(c: Column) -> Column:
    """Whether ``clean`` drops a character of it."""
    return c.rlike(r"[\p{C}&&[^\r\n\t]]")


def is_printable_ascii(c: Column) -> Column:
    """Whether it has blanks and visible ASCII characters only, so that ``strip`` and ``clean`` drop nothing but blanks."""
    return c.rlike(r"^[ -~]*+\z")


def has_break(c: Column) -> Column:
    """Whether it has white space other than blanks, which ``collapse_spaces`` replaces."""
    return c.rlike(r"[^\S ]")


def collapse_spaces(c: Column, breaks: Column | None = None) -> Column:
    # Guarded: most cells have nothing to collapse, and a search is cheaper than a rebuilt string.
    doubled = F.contains(c, F.lit("  ")) | (has_break(c) if breaks is None else breaks)
    return F.when(doubled, F.regexp_replace(c, r"\s+", " ")).otherwise(c)


def strip_leading_zeros(c: Column) -> Column:
    return F.ltrim(c, F.lit("0"))


def key(c: Column) -> Column:
    """Case- and padding-insensitive key part; NULL becomes ''."""
    return F.upper(strip(F.coalesce(c, F.lit(""))))


def clean_key(c: Column) -> Column:
    return F.upper(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\p{Cc}", "")))


def or_missing(c: Column) -> Column:
    return F.coalesce(nonblank(c), F.lit("(missing)"))


def friendly(c: Column) -> Column:
    """Friendly label of a column name held as data; unknown names stay."""
    pairs = [F.lit(x) for name, label in fixed.FRIENDLY_NAMES.items() for x in (name.lower(), label)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(c)), c)


def friendly_name(name: str) -> str:
    return {k.lower(): v for k, v in fixed.FRIENDLY_NAMES.items()}.get(name.lower(), name)


# --- Column look-up by name, ignoring case -------------------------------------


def find(df: DataFrame, name: str) -> str | None:
    """The frame's own spelling of a column name, or None."""
    wanted = name.lower()
    return next((c for c in df.schema.names if c.lower() == wanted), None)


def first_found(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in (find(df, x) for x in names) if n is not None), None)


def column(df: DataFrame, name: str) -> Column:
    """Reference by exact name; quoted, since names may contain dots and spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once per row, whatever reads them later.

    A filter on a plain computed column is pushed below it with a second copy of
    its expression. The one-element ``inline`` keeps the filter above.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def cell(df: DataFrame, name: str) -> Column:
    """The column as text with NULL and absent both ''."""
    found = find(df, name)
    if found is None:
        return F.lit("")
    kind = df.schema[found].dataType
    c = column(df, found)
    if isinstance(kind, T.DecimalType):
        text = F.call_function("format_number", c, F.lit("0." + "#" * max(kind.scale, 1)))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))

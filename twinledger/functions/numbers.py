"""Numbers held as text, and numbers shown as text.

Amounts are DECIMAL(38,6): sums and tolerances are exact, and every value of a 128-bit
decimal number (up to 7.9E28) fits. Four grammars are accepted, from the lenient feed
number to the strict whole number; none raises, unreadable text is NULL. A value of more
than 32 integer digits is NULL too and is reported by the ingest findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

AMOUNT = T.DecimalType(38, 6)
TOTAL = AMOUNT

# Accepted number formats.
_GROUPED = r"(?:\d[\d,]*\.?\d*|\.\d+)"
_UNGROUPED = r"(?:\d+\.?\d*|\.\d+)"
_EXPONENT = r"(?:[eE][+-]?\d+)?"
LENIENT = (
    rf"^\s*(?:[+-]?\s*{_GROUPED}{_EXPONENT}|{_GROUPED}{_EXPONENT}\s*[+-]"
    rf"|\(\s*{_GROUPED}{_EXPONENT}\s*\))\s*$"
)
PLAIN_STYLE = rf"^\s*(?:[+-]?{_GROUPED}|{_GROUPED}\s*[+-])\s*$"
MONEY = rf"^(?:[+-]?{_UNGROUPED}{_EXPONENT}|{_UNGROUPED}{_EXPONENT}[+-])$"
WHOLE = r"^\s*[+-]?\d+\s*$"
ORDINARY = rf"^\s*[+-]?{_UNGROUPED}\s*$"
CANONICAL = r"^(?:0|-?[1-9]\d*)(?:\.\d+)?$"
MINUS_BEHIND = r"^[1-9]\d*(?:\.\d+)?-\z"
IN_PARENTHESES = r"^\([1-9]\d*(?:\.\d+)?\)\z"

_NEGATIVE = r"^\s*-|\(|-\s*$"
_DECORATION = r"[\s,()]|^\s*[+-]|[+-]\s*$"


def _read(c: Column, kind: T.DataType) -> Column:
    """Reads text already known to follow one of the grammars."""
    size = F.regexp_replace(c, _DECORATION, "").try_cast(kind)
    return F.when(c.rlike(_NEGATIVE), -size).otherwise(size)


def lenient_decimal(c: Column) -> Column:
    """Sign at either end, thousands, parentheses, exponent and spaces allowed."""
    # The guards matter: a failing cast costs far more than a match. Most cells are ordinary.
    return F.when(c.rlike(ORDINARY), F.trim(c).try_cast(AMOUNT)).when(c.rlike(LENIENT), _read(c, AMOUNT))


def rule_decimal(c: Column) -> Column:
    """Sign at either end and thousands; no exponent or parentheses."""
    return F.when(c.rlike(PLAIN_STYLE), _read(c, AMOUNT))


def money_decimal(c: Column) -> Column:
    """Blank is 0; sign at either end and exponent; no thousands or spaces."""
    blank = tx.is_blank(c)
    return F.when(blank, F.lit(0).cast(AMOUNT)).when(c.rlike(MONEY), _read(c, AMOUNT))


def whole_or_zero(c: Column) -> Column:
    return F.coalesce(F.when(c.rlike(WHOLE), F.trim(c).try_cast("int")), F.lit(0))


def _typed(df: DataFrame, found: str, parse) -> Column:
    c = tx.column(df, found)
    if tx.is_text(df, found):
        return parse(c)
    return c.try_cast(AMOUNT)


def amount(df: DataFrame, name: str, fallback: str | None = None) -> Column:
    """Amount of a feed column, 0 when absent, blank or unreadable.

    The fallback column is read only where the main one is blank: a main cell
    with unreadable text counts as 0.
    """
    zero = F.lit(0).cast(AMOUNT)
    main, other = tx.find(df, name), tx.find(df, fallback) if fallback else None
    if other is not None:
        second = F.coalesce(_typed(df, other, lenient_decimal), zero)
    else:
        second = zero
    if main is None:
        return second
    first = F.coalesce(_typed(df, main, lenient_decimal), zero)
    if other is None:
        return first
    c = tx.column(df, main)
    blank = tx.is_blank(c) if tx.is_text(df, main) else c.isNull()
    return F.when(blank, second).otherwise(first)


def is_beyond_range(df: DataFrame, name: str, fallback: str | None = None) -> Column:
    """Whether ``amount`` reads 0 for a number that is too large to be held."""
    found = tx.find(df, name)
    other = F.lit(False) if fallback is None else is_beyond_range(df, fallback)
    if found is None:
        return other
    c = tx.column(df, found)
    if tx.is_text(df, found):
        # Up to 32 characters without an exponent always fit.
        long = (F.length(c) > 32) | F.contains(c, F.lit("e")) | F.contains(c, F.lit("E"))
        own, blank = long & c.rlike(LENIENT) & lenient_decimal(c).isNull(), tx.is_blank(c)
    else:
        own, blank = c.isNotNull() & c.try_cast(AMOUNT).isNull(), c.isNull()
    return F.coalesce(own if fallback is None else F.when(blank, other).otherwise(own), F.lit(False))


_LIMB = 10 ** 12
_WHOLE_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10}


def is_below_limb(df: DataFrame, name: str, fallback: str | None = None) -> bool:
    """Whether the type of a feed column keeps all its amounts below a trillion, with at most six decimals."""
    found = [n for n in (tx.find(df, name), tx.find(df, fallback) if fallback else None) if n is not None]
    kinds = [df.schema[n].dataType for n in found]
    return all(k.precision - k.scale <= 12 and k.scale <= 6 if isinstance(k, T.DecimalType) else type(k) in _WHOLE_DIGITS for k in kinds)


def wide_sum(c: Column, below_limb: bool = False) -> Column:
    """The exact sum of amounts in any order of addition; NULL for no amount and for a sum that can't be held.

    What lies below and what lies above a trillion is summed apart, so no partial sum overflows.
    Nearly all amounts have only the lower part, in which they pass as 64-bit numbers; where the types
    of the columns tell that all do (``is_below_limb``), a partial sum is half as wide.
    """
    low = c.try_cast("decimal(18,6)")
    if below_limb:
        return F.sum(low).cast(TOTAL)
    rest = c % F.lit(_LIMB).cast("decimal(13,0)")
    lower = F.sum(F.coalesce(low, rest.cast("decimal(18,6)")))
    upper = F.sum(F.when(low.isNull(), ((c - rest) / F.lit(_LIMB).cast("decimal(13,0)")).cast("decimal(20,0)")))
    # A sum of more than 25 digits can't be held either: some 100,000 of the largest amounts reach it.
    above = F.try_multiply(F.coalesce(upper, F.lit(0)).try_cast("decimal(25,0)"), F.lit(_LIMB).cast("decimal(13,0)"))
    return F.when(upper.isNull(), lower.cast(TOTAL)).otherwise(F.try_add(above.try_cast(TOTAL), lower.cast(TOTAL)))


def difference(a: Column, b: Column) -> Column:
    """a - b, to four decimals where it can't be held with six."""
    wide = T.DecimalType(38, 4)
    return F.coalesce(F.try_subtract(a, b), F.try_subtract(a.cast(wide), b.cast(wide)))


def rule_amount(df: DataFrame, name: str) -> Column:
    found = tx.find(df, name)
    zero = F.lit(0).cast(AMOUNT)
    return zero if found is None else F.coalesce(_typed(df, found, rule_decimal), zero)


# --- Number cells of a feed, normalised as text -----------------------------------


def number_text(c: Column) -> Column:
    """Canonical text of a feed number, NULL when unreadable.

    Works on the digits themselves, so precision and trailing zeros survive.
    What the lenient grammar rejects is retried with all other characters removed.
    """
    kept = _only_number_characters(c)
    return _canonical(c).when(kept.rlike(CANONICAL), kept).when(kept.rlike(LENIENT), _tidy_digits(kept))


def lenient_number_text(c: Column) -> Column:
    return _canonical(c)


def may_be_number(c: Column) -> Column:
    """False for text that cannot be a number: it begins with none of the characters a stripped one can begin with."""
    return (c >= "(") & (c < ":")


def has_exponent(c: Column) -> Column:
    return F.contains(c, F.lit("e")) | F.contains(c, F.lit("E"))


def is_unreadable_number(c: Column) -> Column:
    return ~c.rlike(LENIENT) & ~_only_number_characters(c).rlike(LENIENT)


def _only_number_characters(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d.\-]", "")


def _canonical(c: Column) -> Column:
    exact = F.coalesce(*[  # the narrower scale holds the greater numbers
        F.call_function("format_number", _read(c, kind), F.lit("0.##########")) for kind in (T.DecimalType(38, 10), AMOUNT)])
    # Plain negative amounts of either form need no search and replacement.
    return (
        F.when(c.rlike(CANONICAL), c)
        .when(c.endswith("-") & c.rlike(MINUS_BEHIND), F.concat(F.lit("-"), F.left(c, F.length(c) - 1)))
        .when(c.startswith("(") & c.rlike(IN_PARENTHESES), F.concat(F.lit("-"), F.substring(c, F.lit(2), F.length(c) - 2)))
        .when(c.rlike(LENIENT), F.when(has_exponent(c), exact).otherwise(_tidy_digits(c)))
    )


def _tidy_digits(c: Column) -> Column:
    """Leading minus, no grouping, no surplus zeros in front. Each step reads the one before only once."""
    bare = F.translate(c, " ,+\t", "")
    minus_first = F.regexp_replace(bare, r"^\((.*)\)$|^([^-].*)-$", "-$1$2")
    no_zeros = F.regexp_replace(minus_first, r"^(-?)0+(?=\d)", "$1")
    whole = F.regexp_replace(no_zeros, r"^(-?)\.", "$10.")
    return F.regexp_replace(whole, r"\.$|^-(?=0(?:\.0*)?$)", "")


# --- Numbers shown as text ------------------------------------------------------------


def short(c: Column) -> Column:
    """At most two decimals. Rounded first: the formatter alone rounds half to even."""
    return F.call_function("format_number", F.round(c, 2), F.lit("0.##"))


def signed(c: Column) -> Column:
    return F.call_function("format_number", F.round(c, 2), F.lit("+0.##;-0.##"))


def plain(c: Column) -> Column:
    return F.call_function("format_number", c, F.lit("0.############"))


def short_if_number(c: Column) -> Column:
    """Shortens a numeric cell, keeping a trailing percent sign; other text stays."""
    percent = F.rtrim(c).endswith("%")
    value = lenient_decimal(F.regexp_replace(c, "%+$", ""))
    shown = F.concat(short(value), F.when(percent, F.lit("%")).otherwise(F.lit("")))
    return F.when(value.isNotNull(), shown).otherwise(c)

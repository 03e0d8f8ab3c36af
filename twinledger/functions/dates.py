"""Dates held as text. Times are read in the session time zone, which should be UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

# Accepted date formats.
_TIME = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"
ISO = rf"^\d{{4}}([-/])\d{{1,2}}\1\d{{1,2}}(?:[T ]{_TIME}(?:Z|[+-]\d{{2}}:\d{{2}})?)?$"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
US_DAY = r"^\d{1,2}/\d{1,2}/\d{4}\z"
US = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})( {_TIME})?$"
# Month names and 12-hour times: one guard, one pattern of optional sections.
NAMED = r"^\d{1,2}([ -])[A-Za-z]{3,9}\1\d{4}$|^[A-Za-z]{3,9} \d{1,2}, \d{4}$|^\d{1,2}/\d{1,2}/\d{4} [\d:]{4,8} [AP]M$"
NAMED_PATTERN = (
    "[M/d/yyyy h:mm:ss a][M/d/yyyy h:mm a][d MMM yyyy][d MMMM yyyy][d-MMM-yyyy][d-MMMM-yyyy]"
    "[MMM d, yyyy][MMMM d, yyyy]"
)

UNREADABLE = "0001-01-01"


def parse_timestamp(c: Column, stripped: bool = False) -> Column:
    """NULL when unreadable. The regex guards keep failing casts and the pattern parser off ordinary cells."""
    t = c if stripped else tx.strip(c)
    us = F.regexp_replace(t, US, "$3-$1-$2$4")
    return (
        F.when(t.rlike(ISO), F.translate(t, "/", "-").try_cast("timestamp"))
        .when(t.rlike(US), us.try_cast("timestamp"))
        .when(t.rlike(NAMED), F.try_to_timestamp(t, F.lit(NAMED_PATTERN)))
    )


def parse_date(c: Column) -> Column:
    return parse_timestamp(c).cast("date")


def date_text(c: Column, stripped: bool = False) -> Column:
    """ISO text of a date, NULL when unreadable; plain ISO and US days take a short way.

    ``stripped`` tells that the text has no white space at its ends.
    """
    us = F.concat(F.right(c, F.lit(4)), F.lit("-"), F.translate(F.substring_index(c, "/", 2), "/", "-"))
    return (
        F.when((F.length(c) == 10) & c.rlike(ISO_DAY), F.when(c.try_cast("date").isNotNull(), c))
        .when(F.contains(c, F.lit("/")) & c.rlike(US_DAY), us.try_cast("date").cast("string"))
        .otherwise(parse_timestamp(c, stripped).cast("date").cast("string"))
    )


def date_or_lowest(df: DataFrame, name: str) -> Column:
    """The column as a date; absent, blank and unreadable are the lowest date."""
    lowest = F.lit(UNREADABLE).cast("date")
    found = tx.find(df, name)
    if found is None:
        return lowest
    c = tx.column(df, found)
    kind = df.schema[found].dataType
    value = parse_date(c) if isinstance(kind, T.StringType) else c.cast("date")
    return F.coalesce(value, lowest)


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1

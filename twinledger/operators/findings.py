"""The findings table and its reports.

A finding is one row; ``row`` is -1 for findings about a whole feed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..options import DEFAULTS, Options

FINDING_TYPE = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("row", T.LongType()),
    T.StructField("column", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("raw_value", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("is_summary", T.BooleanType()),
])

#: A finding that is kept with its row, which has its number and file: level, rule and column are one text, as in "Error|Q7|Quantity".
NOTE_TYPE = T.StructType([T.StructField("what", T.StringType()), *[FINDING_TYPE[n] for n in ("description", "raw_value", "context")]])

GROUP = ("level", "column", "description")


def finding(
    condition: Column, *, level: str, rule: str, column: str, description: Column | str,
    raw: Column | str = "", row: Column | None = None, file_name: Column | str = "",
    context: Column | str = "",
) -> Column:
    """A finding struct where the condition holds, else NULL."""
    return F.when(condition, _struct(level, rule, column, description, raw, row, file_name, context))


def rule_finding(condition: Column, *, level: str, rule: str, column: str, description: Column | str, raw: Column | str = "",
                 row: Column | None = None, file_name: Column | str = "", context: Column | str = "", kind: T.StructType = FINDING_TYPE) -> Column:
    """An array of the finding where the condition holds, else an empty one. ``kind`` may be ``NOTE_TYPE``."""
    made = _struct(level, rule, column, description, raw, row, file_name, context, kind)
    return F.when(condition, F.array(made)).otherwise(F.array().cast(T.ArrayType(kind)))


def _struct(level, rule, column, description, raw, row, file_name, context, kind=FINDING_TYPE) -> Column:
    def text(value):
        return F.lit(value) if isinstance(value, str) else value

    raw_text = text(raw)
    values = {
        "what": F.lit(f"{level}|{rule}|{column}"),
        "level": F.lit(level),
        "rule": F.lit(rule),
        "row": (F.lit(-1) if row is None else row).cast("long"),
        "column": F.lit(column),
        "description": text(description),
        "raw_value": F.coalesce(tx.nonblank(raw_text), F.lit("")),
        "file_name": text(file_name),
        "context": text(context),
        "is_summary": F.lit(False),
    }
    return F.struct(*[values[n].alias(n) for n in kind.names])


def found_by(rules: Sequence[Column], kind: T.StructType = FINDING_TYPE) -> Column:
    """The findings of a row as one array, from those of each rule.

    Arrays are joined, since leaving NULLs out of one is a lambda, below which no rule is compiled
    and no expression is shared.
    """
    if not rules:
        return F.array().cast(T.ArrayType(kind))
    return F.concat(*rules).cast(T.ArrayType(kind))


def of_notes(notes: DataFrame, row: Column, file_name: Column) -> DataFrame:
    """The findings of rows that are ``NOTE_TYPE``, about a row and file."""
    what = F.split("what", r"\|", 3)
    values = {"level": what[0], "rule": what[1], "row": row, "column": what[2], "file_name": file_name, "is_summary": F.lit(False)}
    return notes.select(*[values.get(n, F.col(n)).alias(n) for n in FINDING_TYPE.names])


def collect_findings(df: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """Evaluates any number of rules in one projection; one output row per finding.

    The outer form matters: below the inner one the optimiser puts a filter on the array's
    size, which evaluates all rules a second and a third time.
    """
    if not rules:
        return df.sparkSession.createDataFrame([], FINDING_TYPE)
    return df.select(found_by(rules).alias("found")).select(F.inline_outer("found")).where(F.col("level").isNotNull())


_ORDER = ("row", "raw_value", "file_name", "context")
_HELD = 50_000
_PARTIAL = T.StructType([*FINDING_TYPE, *(T.StructField(n, t) for n, t in (
    ("_n", T.LongType()), ("_file", T.StringType()), ("_least", T.StringType()))) ])


def _least_rows(limit: int):
    """Reduces a partition's findings to the first rows of each group, the first of them with the group's count.

    At most some ``_HELD`` rows are held; groups that were passed on before may come again.
    """
    def reduced(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True).sort_values([*GROUP, *_ORDER], kind="stable", ignore_index=True)
        groups = rows.groupby(list(GROUP), sort=False, dropna=False)
        nth = groups.cumcount()
        rows["_n"] = groups["_n"].transform("sum").where(nth == 0, 0)
        rows["_file"], rows["_least"] = groups["_file"].transform("min"), groups["_least"].transform("min")
        return rows[nth < limit]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame.assign(_n=1, _file=frame["file_name"], _least=frame["rule"]))
            if sum(map(len, held)) > _HELD:
                held = [reduced(held)]
                if len(held[0]) > _HELD // 2:
                    yield held.pop()
        if held:
            yield reduced(held)

    return run


def cap_per_group(findings: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """The first rows of every (level, column, description) group and one overflow row per larger group.

    The findings are evaluated once: each partition is reduced to the counts and first rows of its
    groups, and these small tables are merged, first in 256 shares, then as a whole. So a group of
    any size reaches one task only as a few rows.
    """
    limit = options.max_detailed_rows
    rest = [n for n in FINDING_TYPE.names if n not in GROUP and n not in _ORDER]
    line = F.struct(*_ORDER, *rest)

    def merged(rows: DataFrame, lines: Column, *keys: str) -> DataFrame:
        least = F.slice(F.array_sort(lines), 1, limit)
        return rows.groupBy(*GROUP, *keys).agg(
            F.sum("_n").alias("_n"), F.min("_file").alias("_file"), F.min("_least").alias("_least"), least.alias("lines"))

    parts = findings.select(*FINDING_TYPE.names).mapInPandas(_least_rows(limit), _PARTIAL)
    shares = merged(parts.withColumn("_share", F.spark_partition_id() % 256), F.collect_list(line), "_share")
    whole = merged(shares, F.flatten(F.collect_list("lines")))
    text = F.concat((F.col("_n") - limit).cast("string"), F.lit(" additional rows had the same error: "), F.col("description"))
    first = F.transform("lines", lambda x: F.struct(*[
        (F.col(n) if n in GROUP else x[n]).alias(n) for n in FINDING_TYPE.names]))
    overflow = F.struct(
        F.col("level"), F.col("_least").alias("rule"), F.lit(-1).cast("long").alias("row"), F.col("column"), text.alias("description"),
        F.lit("").alias("raw_value"), F.col("_file").alias("file_name"), F.lit("").alias("context"), F.lit(True).alias("is_summary"))
    more = F.when(F.col("_n") > limit, F.array(overflow)).otherwise(F.array().cast(T.ArrayType(FINDING_TYPE)))
    return whole.select(F.concat(first.cast(T.ArrayType(FINDING_TYPE)), more.cast(T.ArrayType(FINDING_TYPE))).alias("found")).select(F.inline_outer("found"))


def counts_by_description(findings: DataFrame) -> DataFrame:
    return findings.groupBy("level", "description").agg(F.count(F.lit(1)).alias("n"))


def counts_by_level(log: DataFrame, weight: str | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return log.groupBy("level").agg(n.cast("long").alias("n"))


def of_level(findings: DataFrame, level: str) -> DataFrame:
    return findings.where(F.col("level") == level)


def has_level(findings: DataFrame, level: str) -> bool:
    return not of_level(findings, level).isEmpty()


def search(df: DataFrame, term: str) -> DataFrame:
    """Rows whose field name, explanation or reason contains the term, ignoring case."""
    names = [n for n in (tx.find(df, x) for x in ("Field Name", "Explanation", "Reason")) if n]
    if not term.strip() or not names:
        return df
    hit = F.lit(False)
    for name in names:
        hit = hit | F.contains(F.lower(tx.cell(df, name)), F.lit(term.lower()))
    return df.where(hit)

"""Report sinks. Every sink is a distributed write; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text as tx
from ..operators.invoice_rules import with_severity
from ..operators.positional_diff import order_differences
from ..staging import shuffles_dropped


def _now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def _csv(df: DataFrame, path: str, compression: str | None = None) -> None:
    """The shuffle files behind a written report go with its end."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path, compression=compression)


def findings_report(findings: DataFrame) -> DataFrame:
    """All findings, uncapped, with friendly column names and short numbers."""
    return findings.select(
        _now().alias("Timestamp"),
        F.col("level").alias("ErrorLevel"),
        F.when(F.col("row") > 0, F.col("row").cast("string")).otherwise("").alias("RowNumber"),
        tx.friendly(F.col("column")).alias("ColumnName"),
        num.short_if_number(F.col("description")).alias("Description"),
        num.short_if_number(F.col("raw_value")).alias("RawValue"),
        F.col("file_name").alias("FileName"),
        F.col("context").alias("Context"),
    )


def write_findings(findings: DataFrame, path: str) -> None:
    _csv(findings_report(findings), path)


def write_differences(diffs: DataFrame, summary: DataFrame, path: str) -> None:
    """Ordered differences, and the summary line as a small data set beside them."""
    _csv(order_differences(diffs).drop("Column", "Group"), f"{path}/differences")
    _csv(summary, f"{path}/summary")


def log_report(log: DataFrame) -> DataFrame:
    return log.select(
        _now().alias("Timestamp"), F.col("level").alias("Level"), F.col("message").alias("Message"),
        F.col("occurrences").alias("Occurrences"),
    )


def write_log(log: DataFrame, path: str) -> None:
    _csv(log_report(log), path)


def write_key_diagnostics(diagnostics: DataFrame, path: str) -> None:
    _csv(diagnostics, path)


def write_result(result: DataFrame, path: str, summary: DataFrame | None = None, compression: str | None = None) -> None:
    """A result table as CSV, its summary line beside it. ``compression`` (as "gzip") is for its rows: a large one is mostly digits."""
    _csv(result, f"{path}/rows", compression)
    if summary is not None:
        _csv(summary, f"{path}/summary")


def write_invalid_rows(invalid: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """Rows failing the invoice rules, with their severity."""
    write_result(with_severity(invalid), path, summary)

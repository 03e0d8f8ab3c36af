"""Data-quality rules over a raw feed: all row rules in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fixed
from ..functions import dates as dt
from ..functions import numbers as num
from ..functions import text as tx
from ..options import DEFAULTS, Options
from .findings import FINDING_TYPE, collect_findings, counts_by_description, finding, found_by, rule_finding
from .schema import FILE, MARKS, ROW


def context(df: DataFrame) -> Column:
    customer, sku = tx.or_missing(tx.cell(df, "CustomerName")), tx.or_missing(tx.cell(df, "SkuId"))
    return F.concat(F.lit("Customer: "), customer, F.lit(", SKU: "), sku)


def row_rules(df: DataFrame, file_name: str = "", kind: T.StructType = FINDING_TYPE) -> tuple[DataFrame, list[Column]]:
    """The feed with the cells that the row rules Q1 to Q5 read parsed once, and the rules' findings."""
    feed = [c for c in df.columns if c not in MARKS]
    quantity, zero = F.col("_quantity"), F.lit(0)
    priced = {n: found for n in fixed.PRICED_COLUMNS if (found := tx.find(df, n)) is not None}
    totals = [c for c in feed if "total" in c.lower()]
    amounts = {c: f"_amount_{i}" for i, c in enumerate(dict.fromkeys([*priced.values(), *totals]))}
    # Each amount is parsed once, in a projection of its own.
    parsed = df.withColumns({
        "_quantity": num.amount(df, "Quantity"),
        "_context": context(df),
        **{alias: num.amount(df, c) for c, alias in amounts.items()},
    })
    common = {
        "row": F.col(ROW) if ROW in df.columns else None,
        "file_name": F.col(FILE) if FILE in df.columns else file_name,
        "context": F.col("_context"),
        "kind": kind,
    }
    rules: list[Column] = []
    positive = quantity > 0
    for name, found in priced.items():
        raw, value = tx.cell(df, found), F.col(amounts[found])
        rules.append(rule_finding(
            positive & (value == zero), level="Warning", rule="Q1", column=found, raw=raw,
            description=F.concat(F.lit("Value is 0 or blank while Quantity is "), num.plain(quantity)), **common,
        ))
        if "discount" in name.lower():
            outside = (value < 0) | (value > 100)
            rules.append(rule_finding(
                outside, level="Error", rule="Q2a", column=found, raw=raw,
                description="Discount percentage out of bounds (0-100)", **common,
            ))
            rules.append(rule_finding(
                ~outside & ((value < 1) | (value > 90)), level="Warning", rule="Q2b", column=found, raw=raw,
                description="Suspicious discount (<1% or >90%)", **common,
            ))
    all_zero = F.lit(True)
    for found in priced.values():
        all_zero = all_zero & (F.col(amounts[found]) == zero)
    rules.append(rule_finding(
        positive & all_zero, level="Error", rule="Q3", column="-",
        description="All pricing fields zero or blank while Quantity not zero", **common,
    ))
    for name in feed:
        raw = tx.cell(df, name)
        if "date" in name.lower() and isinstance(df.schema[name].dataType, T.StringType):
            rules.append(rule_finding(
                ~tx.is_blank(raw) & dt.date_text(raw).isNull(), level="Error", rule="Q4",
                column=name, raw=raw, description="Invalid date format", **common,
            ))
        if name in totals:
            rules.append(rule_finding(
                F.col(amounts[name]) < 0, level="Warning", rule="Q5", column=name, raw=raw,
                description="Negative total value", **common,
            ))
    return parsed, rules


def row_findings(df: DataFrame, file_name: str = "") -> DataFrame:
    """Findings of the row rules Q1 to Q5."""
    return collect_findings(*row_rules(df, file_name))


ROWS = "total_rows"


def _critical(df: DataFrame) -> list[str]:
    return [c for c in (tx.find(df, n) for n in fixed.CRITICAL_COLUMNS) if c is not None]


def blank_counts(df: DataFrame) -> list[Column]:
    """Aggregates: the rows, and per critical column those that are blank or zero."""
    blank = [F.count_if(num.amount(df, c) == 0).alias(f"_{i}") for i, c in enumerate(_critical(df))]
    return [F.count(F.lit(1)).alias(ROWS), *blank]


def blank_rates(df: DataFrame) -> DataFrame:
    """Rows with a blank or zero value per critical column: one aggregate, then one row per column."""
    found, counts = _critical(df), df.agg(*blank_counts(df))
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"_{i}").alias("affected"))
        for i, c in enumerate(found)
    ]
    if not cells:
        return counts.select(
            F.lit(0).alias("position"), F.lit("").alias("column"), F.lit(0).cast("long").alias("affected"), ROWS
        ).limit(0)
    return counts.select(F.explode(F.array(*cells)).alias("c"), ROWS).select("c.*", ROWS)


def blank_rate_findings(df: DataFrame, file_name: str = "", options: Options = DEFAULTS) -> DataFrame:
    """Findings about critical columns whose blank-or-zero rate is above the threshold."""
    return _rate_findings(blank_rates(df), file_name, options)


def blank_findings_of(
    spark: SparkSession, df: DataFrame, counted: dict, file_name: str = "", options: Options = DEFAULTS
) -> DataFrame:
    """The same from the values of ``blank_counts(df)`` that were observed: one row per critical column."""
    rows = [(i, c, counted[f"_{i}"], counted[ROWS]) for i, c in enumerate(_critical(df))]
    return _rate_findings(spark.createDataFrame(rows, f"position int, column string, affected long, {ROWS} long"), file_name, options)


def _rate_findings(rates: DataFrame, file_name: str, options: Options) -> DataFrame:
    share = F.try_divide(F.col("affected").cast("decimal(20,0)"), F.col(ROWS).cast("decimal(20,0)"))
    above = F.coalesce(share > F.lit(options.blank_threshold), F.lit(False))
    percent = F.floor(share * 100).cast("string")
    row = finding(
        above, level="Warning", rule="Q6", column="", file_name=file_name,
        description=F.concat(F.lit("More than "), percent,
                             F.lit("% of rows have zero or blank values in column "), F.col("column")),
    )
    named = rates.where(above).select(row.alias("f"), F.col("column").alias("name"))
    return named.select(F.col("f").withField("column", F.col("name")).alias("f")).select("f.*")


def quality_findings(df: DataFrame, file_name: str = "", options: Options = DEFAULTS) -> DataFrame:
    return row_findings(df, file_name).unionByName(blank_rate_findings(df, file_name, options))


def most_common_error(findings: DataFrame) -> DataFrame:
    """The most frequent error description; ties go to the first in text order."""
    counts = counts_by_description(findings).where("level = 'Error'")
    # Ordered pair: smallest negated count first, then the text.
    return counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("description"))).alias("top")).select(
        F.coalesce(F.col("top.description"), F.lit("None")).alias("description"),
        F.coalesce(-F.col("top.n"), F.lit(0)).cast("long").alias("n"),
    )


def quality_summary(df: DataFrame, findings: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """One row: rows, errors, warnings, most common error, columns above the blank threshold."""
    rates = blank_rates(df)
    parts = counts_by_description(findings).unionByName(
        rates.select("position", "column", "affected", F.col(ROWS).alias("_rows")), allowMissingColumns=True
    )
    listed = F.array_sort(F.collect_list(F.struct("position", "column", "affected")))
    return _summary(parts, F.max("_rows"), F.filter(listed, lambda x: x["affected"].isNotNull()), F.lit(0), options)


def feed_summary(df: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """The summary of a feed's own findings, rules and blank rates alike, from one evaluation.

    Every finding is a row, and the first of a data row's also counts that row and its blank cells.
    """
    parsed, rules = row_rules(df)
    names = _critical(df)
    cells = parsed.select(found_by(rules).alias("found"), *[(num.amount(parsed, c) == 0).alias(f"_{i}") for i, c in enumerate(names)])
    each = cells.select("*", F.posexplode_outer("found").alias("pos", "f")).withColumn("new", F.coalesce("pos", F.lit(0)) == 0)
    parts = each.groupBy(F.col("f.level").alias("level"), F.col("f.description").alias("description")).agg(
        F.count("pos").alias("n"), F.count_if("new").alias("_rows"), *[F.count_if(F.col("new") & F.col(f"_{i}")).alias(f"_{i}") for i in range(len(names))])
    counted = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias("affected"))
               for i, c in enumerate(names)]
    listed = F.array(*counted) if counted else F.array().cast("array<struct<position:int,column:string,affected:bigint>>")
    share = F.lit(options.blank_threshold) * F.sum("_rows")
    above = F.size(F.filter(listed, lambda x: x["affected"] > share))
    return _summary(parts, F.sum("_rows"), listed, F.coalesce(above, F.lit(0)), options)


def _summary(parts: DataFrame, rows: Column, listed: Column, more_warnings: Column, options: Options) -> DataFrame:
    """One row from counts per level and description, with the affected rows of the critical columns."""
    error = F.col("level") == "Error"
    summary = parts.agg(
        F.coalesce(rows, F.lit(0)).cast("long").alias("total_rows"),
        F.coalesce(F.sum(F.when(error, F.col("n"))), F.lit(0)).cast("long").alias("errors"),
        (F.coalesce(F.sum(F.when(F.col("level") == "Warning", F.col("n"))), F.lit(0)) + more_warnings).cast("long").alias("warnings"),
        F.min(F.when(error, F.struct((-F.col("n")).alias("n"), F.col("description")))).alias("_top"),
        listed.alias("_listed"),
    )
    over = F.filter("_listed", lambda x: x["affected"] > F.lit(options.blank_threshold) * F.col("total_rows"))
    line = F.transform(over, lambda x: F.concat(
        x["column"], F.lit(": "), x["affected"].cast("string"), F.lit("/"), F.col("total_rows").cast("string")))
    summary = summary.select(
        "total_rows", "errors", "warnings",
        F.coalesce(F.col("_top.description"), F.lit("None")).alias("top_error"), F.array_join(line, "; ").alias("blank_columns"),
    )
    text = F.concat(
        F.lit("Total rows: "), F.col("total_rows").cast("string"),
        F.lit("\nErrors: "), F.col("errors").cast("string"),
        F.lit("\nWarnings: "), F.col("warnings").cast("string"),
        F.lit("\nMost common error: "), F.col("top_error"),
        F.lit(f"\nColumns with blanks >{(options.blank_threshold * 100).normalize():f}%: "), F.col("blank_columns"),
    )
    return summary.withColumn("summary", text)

"""Billing feeds derived from the test tables.

Each text runs unchanged in Spark and in DuckDB and covers its tables whole.
The two sides differ through re-keyed products, changed amounts and changed
spelling, never through dropped rows. Table names are placeholders in braces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.options import Options

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

EXCLUDED = "Supplier#000000005"
OPTIONS = Options(excluded_tenants=(EXCLUDED,))

_CENTS = "CAST(l_extendedprice AS DECIMAL(12,2))"
_TAX = "CAST(l_tax AS DECIMAL(4,2))"


def _text(amount: str) -> str:
    return f"CAST(CAST({amount} AS DECIMAL(14,4)) AS VARCHAR(24))"


# --- Business-key feeds ---------------------------------------------------------

LEFT = f"""
SELECT s_name AS CustomerDomainName,
       CASE WHEN l_partkey % 97 = 0 THEN ''
            WHEN l_orderkey % 19 = 0 THEN concat('P', l_partkey, '-A')
            ELSE concat('P', l_partkey) END AS ProductId,
       'T1' AS PartnerId,
       l_returnflag AS ChargeType,
       CASE WHEN l_linenumber = 7 THEN 'AZURE plan' ELSE 'Seat' END AS ProductName,
       CAST(l_quantity AS DECIMAL(18,6)) AS Quantity,
       CAST(l_extendedprice AS DECIMAL(18,6)) AS UnitPrice,
       CAST(l_extendedprice AS DECIMAL(18,6)) AS Subtotal,
       CAST({_CENTS} * {_TAX} AS DECIMAL(18,6)) AS TaxTotal,
       CAST({_CENTS} * (1 + {_TAX}) AS DECIMAL(18,6)) AS Total
FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey
"""

RIGHT = f"""
SELECT CASE WHEN l_orderkey % 7 = 0 THEN concat('  ', lower(s_name), ' ') ELSE s_name END AS CustomerDomainName,
       CASE WHEN l_partkey % 97 = 0 THEN ''
            WHEN l_orderkey % 17 = 0 THEN concat('p', l_partkey, '-b')
            ELSE concat('P', l_partkey) END AS ProductId,
       CASE WHEN l_orderkey % 23 = 0 THEN '' ELSE 't1' END AS PartnerId,
       l_returnflag AS ChargeType,
       CASE WHEN l_linenumber = 6 THEN 'azure PLAN' ELSE 'Seat' END AS SubscriptionDescription,
       CAST(l_quantity + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,6)) AS Quantity,
       CAST(l_extendedprice AS DECIMAL(18,6)) AS UnitPrice,
       CAST(l_extendedprice AS DECIMAL(18,6)) AS Subtotal,
       CAST({_CENTS} * {_TAX} AS DECIMAL(18,6)) AS TaxTotal,
       CAST({_CENTS} * (1 + {_TAX})
            + CASE WHEN l_orderkey % 11 = 0 THEN 0.004 ELSE 0.000 END AS DECIMAL(18,6)) AS Total
FROM {{lineitem}} JOIN {{supplier}} ON l_suppkey = s_suppkey
"""

# --- Composite-key feeds: amounts as text ------------------------------------------

LEFT_LINES = f"""
SELECT concat('INV', l_orderkey) AS InvoiceNumber,
       CASE WHEN l_orderkey % 19 = 0 THEN concat('s', l_linenumber, '-a') ELSE concat('s', l_linenumber) END AS SkuId,
       {_text('l_extendedprice')} AS UnitPrice,
       {_text('l_quantity')} AS Quantity,
       {_text('l_extendedprice')} AS Subtotal,
       {_text(f'{_CENTS} * {_TAX}')} AS TaxTotal,
       {_text(f'{_CENTS} * (1 + {_TAX})')} AS Total
FROM {{lineitem}}
"""

RIGHT_LINES = f"""
SELECT concat('inv', l_orderkey) AS InvoiceNumber,
       CASE WHEN l_orderkey % 17 = 0 THEN concat('S', l_linenumber, '-b') ELSE concat('S', l_linenumber) END AS SkuId,
       {_text('l_extendedprice')} AS UnitPrice,
       CASE WHEN l_orderkey % 29 = 0 THEN 'n/a' ELSE {_text('l_quantity')} END AS Quantity,
       {_text(f'{_CENTS} + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END')} AS Subtotal,
       {_text(f'{_CENTS} * {_TAX}')} AS TaxTotal,
       {_text(f'{_CENTS} * (1 + {_TAX}) + CASE WHEN l_orderkey % 11 = 0 THEN 0.004 ELSE 0.000 END')} AS Total
FROM {{lineitem}}
"""

# The same lines under six keys: every key holds about a sixth of all rows.
LEFT_HOT = f"""
SELECT l_returnflag AS InvoiceNumber, l_linestatus AS SkuId,
       {_text('l_quantity')} AS Quantity, {_text('l_extendedprice')} AS Subtotal,
       {_text(f'{_CENTS} * {_TAX}')} AS TaxTotal
FROM {{lineitem}}
"""
RIGHT_HOT = f"""
SELECT lower(l_returnflag) AS InvoiceNumber, lower(l_linestatus) AS SkuId,
       CASE WHEN l_orderkey % 29 = 0 THEN 'n/a' ELSE {_text('l_quantity')} END AS Quantity,
       {_text(f'{_CENTS} + CASE WHEN l_orderkey % 13 = 0 THEN 0.01 ELSE 0.00 END')} AS Subtotal,
       {_text(f'{_CENTS} * {_TAX}')} AS TaxTotal
FROM {{lineitem}}
"""

# --- Invoice-rule feed -----------------------------------------------------------------

_SHIP = "CAST(l_shipdate AS DATE)"
INVOICE = f"""
SELECT concat('INV', l_orderkey) AS InvoiceNumber,
       CAST(l_linenumber AS VARCHAR(12)) AS SkuId,
       CAST({_SHIP} AS VARCHAR(10)) AS ChargeStartDate,
       CAST({_SHIP} + CAST(l_quantity AS INT) AS VARCHAR(10)) AS ChargeEndDate,
       CAST(CAST(l_quantity AS INT) + CASE WHEN l_linenumber = 4 THEN 0 ELSE 1 END AS VARCHAR(12)) AS EffectiveDays,
       {_text("p_size * 0.25")} AS MSRP,
       CAST(CAST(15 + l_discount * 100 AS DECIMAL(8,2)) AS VARCHAR(24)) AS PartnerDiscountPercentage,
       CASE WHEN l_linenumber = 1 THEN '100' ELSE {_text('l_tax * 300')} END AS CustomerDiscountPercentage,
       {_text(f'{_CENTS} * (1 + {_TAX})')} AS Total,
       CASE WHEN l_linenumber = 1 AND l_returnflag = 'A' THEN '0'
            ELSE {_text(f'{_CENTS} + 1000')} END AS CustomerSubtotal
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
"""

# The same with discounts that are missing, negative, or next to the bounds where rounding decides.
INVOICE_BOUNDS = INVOICE.replace(
    "CAST(CAST(15 + l_discount * 100 AS DECIMAL(8,2)) AS VARCHAR(24))",
    "CASE l_linenumber WHEN 1 THEN '0' WHEN 2 THEN '-2.5' WHEN 3 THEN '17.95' WHEN 4 THEN '17.94' WHEN 5 THEN '20.14' ELSE '20.15' END")

# --- Data-quality feed -------------------------------------------------------------------

QUALITY = f"""
SELECT CASE WHEN l_suppkey % 10 = 0 THEN ' ' ELSE concat('Customer ', l_suppkey) END AS CustomerName,
       concat('S', l_linenumber) AS SkuId,
       CASE WHEN l_linenumber = 7 THEN '0' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(12)) END AS Quantity,
       CASE l_returnflag WHEN 'A' THEN {_text('l_discount * 1100')}
                         WHEN 'R' THEN {_text('l_discount * 100 - 1')} ELSE '' END AS PartnerDiscountPercentage,
       CASE WHEN l_linestatus = 'F' THEN '0.00' ELSE {_text('l_extendedprice')} END AS PartnerEffectiveUnitPrice,
       CASE WHEN l_linestatus = 'F' THEN '' ELSE {_text('l_extendedprice')} END AS CustomerUnitPrice,
       CASE WHEN l_linestatus = 'F' THEN '0' ELSE '1' END AS CustomerPerDayUnitPrice,
       {_text(f'CASE WHEN l_linenumber = 3 THEN -1 ELSE 1 END * {_CENTS} * {_TAX}')} AS PartnerTaxTotal,
       CASE WHEN l_linenumber <= 2 THEN '' ELSE {_text('l_extendedprice')} END AS CustomerSubTotal,
       CASE WHEN l_linenumber = 5 THEN concat('due ', l_linestatus)
            WHEN l_linenumber = 6 THEN ' '
            ELSE CAST({_SHIP} AS VARCHAR(10)) END AS OrderDate
FROM {{lineitem}}
"""

# --- Positional feeds: orders, and orders with changed cells and appended rows ----------

_ORDERED = "CAST(o_orderdate AS DATE)"
_PRICE = "CAST(o_totalprice AS DECIMAL(14,2))"
LEFT_POSITIONS = f"""
SELECT o_orderkey AS position,
       o_orderpriority AS SkuId,
       CAST(o_custkey AS VARCHAR(20)) AS Quantity,
       CAST({_ORDERED} AS VARCHAR(10)) AS OrderDate,
       {_text(_PRICE)} AS Amount,
       {_text(_PRICE)} AS PerDayUnitPrice,
       o_orderstatus AS Note
FROM {{orders}}
"""
RIGHT_POSITIONS = f"""
SELECT o_orderkey AS position,
       CASE WHEN o_orderkey % 13 = 0 THEN 'none' ELSE lower(o_orderpriority) END AS SkuId,
       CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_custkey + 1 AS VARCHAR(20))
            ELSE concat(' ', o_custkey, '.00') END AS Quantity,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST({_ORDERED} + 1 AS VARCHAR(10))
            WHEN o_orderkey % 3 = 0
            THEN concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate))
            ELSE CAST({_ORDERED} AS VARCHAR(10)) END AS OrderDate,
       {_text(f"{_PRICE} + CASE WHEN o_orderkey % 7 = 0 THEN 0.5 WHEN o_orderkey % 5 = 0 THEN 0.005 ELSE 0.0 END")}
         AS Amount,
       {_text(f"{_PRICE} + CASE WHEN o_orderkey % 10 = 0 THEN 0.06 WHEN o_orderkey % 4 = 0 THEN 0.04 ELSE 0.0 END")}
         AS PerDayUnitPrice,
       CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderstatus END AS Note
FROM {{orders}}
UNION ALL
SELECT 1000000000000 + n_nationkey, n_name, '1', '2024-01-01', '1', '1', '' FROM {{nation}}
"""

# --- Raw feeds for the imports ------------------------------------------------------------

_COMMON_CELLS = {
    "CustomerDomainName": "concat(' cust-', l_suppkey, '.com ')",
    "ProductId": "CASE WHEN l_partkey % 89 = 0 THEN ' ' ELSE concat('p', l_partkey) END",
    "ChargeType": "CASE WHEN l_linenumber <= 6 THEN 'Usage' ELSE 'Seat  fee' END",
}
_RIGHT_CELLS = {
    "InvoiceNumber": "concat('inv', l_orderkey)",
    "SkuId": "concat('00', l_linenumber)",
    "ProductName": "concat('0', l_linenumber, '  name')",
    "UnitPrice": f"concat('$', {_text('l_extendedprice')})",
    "Quantity": "concat('(', CAST(CAST(l_quantity AS INT) AS VARCHAR(12)), ')')",
    "Subtotal": f"CASE WHEN l_linenumber = 2 THEN 'n/a' ELSE concat({_text('l_extendedprice')}, '-') END",
    "ChargeStartDate": "concat(month(l_shipdate), '/', day(l_shipdate), '/', year(l_shipdate))",
    "ChargeEndDate": f"""CASE WHEN l_linenumber = 3 THEN 'soon' ELSE concat(CAST({_SHIP} AS VARCHAR(10)), 'T10:11:12Z') END
        """,
    "TermAndBillingCycle": """CASE l_linenumber WHEN 1 THEN 'One-Year commitment for monthly/yearly billing'
                         WHEN 2 THEN 'One-Year commitment for yearly billing'
                         WHEN 3 THEN 'One-Month commitment for monthly billing'
                         WHEN 4 THEN '1 Cache Instance Hour'
                         WHEN 5 THEN 'Three-3 Years commitment for monthly/3 Years/yearly billing'
                         WHEN 6 THEN 'Other' ELSE '' END""",
    "BillingFrequency": "CASE WHEN l_linestatus = 'F' THEN '' ELSE 'Monthly' END",
    "SubscriptionDescription": "CASE WHEN l_returnflag = 'R' THEN 'Azure plan' ELSE 'Service' END",
    "ExtraColumn": "'dropped'",
}


def _select(cells: dict[str, str]) -> str:
    return ",".join(f"\n       {cell} AS {name}" for name, cell in cells.items())


_RAW_COMMON = f"{_select(_COMMON_CELLS)},\n"
RAW_RIGHT = f"""
SELECT {_RAW_COMMON}{_select(_RIGHT_CELLS)}
FROM {{lineitem}}
"""
RAW_LEFT = f"""
SELECT {_RAW_COMMON}
       CASE WHEN l_partkey % 89 = 0 AND l_returnflag <> 'N' THEN concat('pn-', l_partkey) ELSE '' END AS PartNumber,
       concat('inv', l_orderkey) AS PartnerInvoiceNumber,
       concat('00sku', l_linenumber) AS SkuName,
       CASE WHEN l_returnflag = 'A' THEN 'Azure plan' ELSE 'Service' END AS ResourceName,
       {_text('l_extendedprice')} AS PartnerUnitPrice,
       CAST(CAST(l_quantity AS INT) AS VARCHAR(12)) AS Quantity,
       {_text('l_extendedprice')} AS PartnerTotal,
       CAST({_SHIP} AS VARCHAR(10)) AS ValidFrom,
       'Annual' AS Term,
       'Monthly' AS BillingCycle,
       concat('REF', l_orderkey) AS InternalReferenceId
FROM {{lineitem}}
"""
RAW_DISTRIBUTOR = f"""
SELECT {_RAW_COMMON}
       concat('Sku', l_linenumber) AS Sku,
       CAST(l_orderkey AS VARCHAR(20)) AS OrderNumber,
       CASE WHEN l_linenumber = 2 THEN '' ELSE CAST({_CENTS} AS VARCHAR(24)) END AS CustomerUnitPrice,
       CASE WHEN l_linenumber = 3 THEN 'many' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(12)) END AS Quantity,
       CAST({_TAX} AS VARCHAR(24)) AS CustomerTax,
       'Monthly' AS Term
FROM {{lineitem}}
"""

# --- Feeds for CSV files: file_no and the order of the rows in a file are known -----------------------

FILES = 8
NUMBERED_RIGHT = RAW_RIGHT.replace(
    "'dropped' AS ExtraColumn", f"'dropped' AS ExtraColumn, l_orderkey, l_linenumber, l_suppkey % {FILES} AS file_no")
_NOTES_CELLS = {
    "Note": """CASE l_orderkey % 7 WHEN 0 THEN concat('two', chr(10), 'lines ', l_linenumber)
                           WHEN 1 THEN concat('say "', l_returnflag, '", twice')
                           WHEN 2 THEN concat('"', chr(10), ',"', chr(10), '"",', l_linestatus)
                           WHEN 3 THEN concat(chr(10), chr(10), l_linestatus, ',')
                           WHEN 4 THEN '' WHEN 5 THEN concat(l_returnflag, '"') ELSE concat(' ', l_returnflag) END""",
    "Price": _text("l_extendedprice"),
}
NOTES = f"""
SELECT l_orderkey, l_linenumber, l_suppkey % {FILES} AS file_no,{_select(_NOTES_CELLS)}
FROM {{lineitem}}
"""
#: The cells of the feeds with a file_no, by their text.
NUMBERED_CELLS = {NUMBERED_RIGHT: {**_COMMON_CELLS, **_RIGHT_CELLS}, NOTES: _NOTES_CELLS}


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A feed text over the parquet tables."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def sql(text: str) -> str:
    """A feed text over views named like the tables."""
    return text.format(**{t: t for t in TABLES}).strip()


def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A feed text with a file_no, dealt by it and ordered by l_orderkey, l_linenumber and all cells.

    The table's rows are dealt and sorted before their cells are spelt out, since as text they are several
    times as wide. In the order a cell is an expression, which is evaluated only where the keys are equal.
    """
    order = ["l_orderkey", "l_linenumber", *map(F.expr, NUMBERED_CELLS[text].values())]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    dealt = rows.repartitionById(FILES, (F.col("l_suppkey") % FILES).cast("int")).sortWithinPartitions(*order)
    return spark.sql(text, lineitem=dealt)

"""Every query of the engine over the test tables, with the SQL that must give the same rows.

Spark results show amounts as DOUBLE, so both engines return the same types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinledger import fixed_values as fixed
from twinledger import staging
from twinledger.functions import dates as dt
from twinledger.functions import numbers as num
from twinledger.functions import text as tx
from twinledger.functions.arithmetic import arithmetic
from twinledger.operators import business_key as bk
from twinledger.operators import data_quality as dq
from twinledger.operators import field_diff as fd
from twinledger.operators import filters
from twinledger.operators import findings as fi
from twinledger.operators import invoice_rules as ir
from twinledger.operators import net_price as npx
from twinledger.operators import ordinals
from twinledger.operators import positional_diff as pdiff
from twinledger.operators import schema as sc
from twinledger.plans import imports, runs
from twinledger.session import tune
from twinledger.sources import feeds as sources
from twinledger.sources import sinks

from . import feeds
from .feeds import OPTIONS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

L, R = fixed.LEFT_LABEL, fixed.RIGHT_LABEL
MISSING_LEFT, MISSING_RIGHT = OPTIONS.missing_left, OPTIONS.missing_right
HUB, MS = fixed.LEFT_PREFIX, fixed.RIGHT_PREFIX


def as_double(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
        else F.col(f"`{f.name}`") for f in df.schema.fields
    ])


def query(sql: str | None = None, name: str | None = None):
    """Registers a query function under its own name."""
    def register(fn: Query) -> Query:
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_double(fn(tune(spark), sf_dir))

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql.strip()
        return fn
    return register


def pair(spark: SparkSession, sf_dir: str, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    return feeds.frame(spark, sf_dir, left), feeds.frame(spark, sf_dir, right)


def business(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two feeds without partner ids, so that no slice applies."""
    left, right = pair(spark, sf_dir, feeds.LEFT, feeds.RIGHT)
    return left.drop("PartnerId"), right.drop("PartnerId")


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.compare_keys(*business(spark, sf_dir), OPTIONS)


# --- SQL building blocks -------------------------------------------------------------


def d(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def short(expr: str) -> str:
    """At most two decimals."""
    return f"rtrim(rtrim(CAST(CAST(round({expr}, 2) AS DECIMAL(28,2)) AS VARCHAR), '0'), '.')"


def signed(expr: str) -> str:
    return f"(CASE WHEN round({expr}, 2) >= 0 THEN '+' ELSE '' END || {short(expr)})"


def friendly(expr: str) -> str:
    cases = " ".join(f"WHEN lower({expr}) = '{k.lower()}' THEN '{v}'" for k, v in fixed.FRIENDLY_NAMES.items())
    return f"CASE {cases} ELSE {expr} END"


def exact_mean(weighted_cents: str, quantity: str) -> str:
    """Quotient rounded half up at six decimals, in whole numbers."""
    n, q = f"({weighted_cents})", f"({quantity})"
    k = f"CASE WHEN {q} = 0 THEN 0 ELSE (2 * {n} * 10000 + {q}) // (2 * {q}) END"
    return f"CAST(CAST(CAST({k} AS BIGINT) AS DECIMAL(20,0)) * CAST('0.000001' AS DECIMAL(6,6)) AS DOUBLE)"


TENANT = feeds.EXCLUDED.upper()


def side_groups(text: str, where: str = "true") -> str:
    return f"""
SELECT upper(trim(CustomerDomainName)) AS c, upper(trim(ProductId)) AS p, CAST(count(*) AS BIGINT) AS n,
       sum(Quantity) AS q, sum(Subtotal) AS s, sum(Total) AS t, sum(TaxTotal) AS x,
       sum(CAST(UnitPrice * 100 AS BIGINT)::HUGEINT * CAST(Quantity AS BIGINT)) AS w,
       sum(CAST(Quantity AS BIGINT)::HUGEINT) AS qi
FROM ({feeds.sql(text)}) feed WHERE {where} GROUP BY 1, 2"""


def keys_sql(right_where: str = "true") -> str:
    """The key table j of both feeds with status; excluded tenants are marked."""
    tol = "0.01"
    return f"""
WITH lg AS ({side_groups(feeds.LEFT)}), rg AS ({side_groups(feeds.RIGHT, right_where)}),
k AS (
  SELECT coalesce(lg.c, rg.c) AS c, coalesce(lg.p, rg.p) AS p,
         coalesce(lg.n, 0) AS ln, coalesce(rg.n, 0) AS rn,
         coalesce(lg.q, 0) AS lq, coalesce(rg.q, 0) AS rq, coalesce(lg.s, 0) AS ls, coalesce(rg.s, 0) AS rs,
         coalesce(lg.t, 0) AS lt, coalesce(rg.t, 0) AS rt, coalesce(lg.x, 0) AS lx, coalesce(rg.x, 0) AS rx,
         coalesce(lg.w, 0) AS lw, coalesce(rg.w, 0) AS rw, coalesce(lg.qi, 0) AS lqi, coalesce(rg.qi, 0) AS rqi
  FROM lg FULL JOIN rg ON lg.c = rg.c AND lg.p = rg.p),
j AS (
  SELECT *, c = '{TENANT}' AS ex, c = '' OR p = '' AS blank,
         CASE WHEN c = '{TENANT}' THEN CASE WHEN ln > 0 AND c <> '' AND p <> '' THEN '{fixed.DATA_ERROR}' END
              WHEN ln > 0 AND (c = '' OR p = '') THEN '{fixed.DATA_ERROR}'
              WHEN rn = 0 THEN '{MISSING_RIGHT}'
              WHEN ln = 0 THEN '{MISSING_LEFT}'
              WHEN abs(lq - rq) <= {tol} AND abs(ls - rs) <= {tol} AND abs(lt - rt) <= {tol} AND abs(lx - rx) <= {tol}
              THEN '{fixed.MATCHED}' ELSE '{fixed.MISMATCHED}' END AS st
  FROM k)
"""


def details_sql() -> str:
    parts = []
    for label, a, b in (("Quantity", "lq", "rq"), ("Subtotal", "ls", "rs"), ("Total", "lt", "rt"), ("TaxTotal", "lx", "rx")):
        parts.append(f"CASE WHEN abs({a} - {b}) > 0.01 THEN '{label}:' || {signed(f'{a} - {b}')} END")
    return f"CASE WHEN st = '{fixed.MISMATCHED}' THEN concat_ws('; ', {', '.join(parts)}) ELSE '' END"


def result_sql(keys: str, where: str = "true") -> str:
    """The comparison result read from a key table."""
    columns = []
    for label, x in (("Quantity", "q"), ("Subtotal", "s"), ("Total", "t"), ("TaxTotal", "x")):
        columns.append(f"{d(f'CASE WHEN ex THEN 0 ELSE l{x} END')} AS {HUB}{label}")
        columns.append(f"{d(f'CASE WHEN st = {chr(39)}{fixed.DATA_ERROR}{chr(39)} THEN 0 ELSE r{x} END')} AS {MS}{label}")
    columns.append(f"CASE WHEN ex THEN 0 ELSE {exact_mean('lw', 'lqi')} END AS {HUB}UnitPrice")
    columns.append(
        f"CASE WHEN st = '{fixed.DATA_ERROR}' THEN 0 ELSE {exact_mean('rw', 'rqi')} END AS {MS}UnitPrice")
    return f"""{keys}
SELECT c AS CustomerDomainName, p AS ProductId, st AS Status, {', '.join(columns)},
       {details_sql()} AS MismatchDetails
FROM j WHERE st IS NOT NULL AND {where}"""


# --- Business-key comparison -------------------------------------------------------------


@query(f"""
WITH g AS ({side_groups(feeds.LEFT)})
SELECT c AS CustomerDomainName, p AS ProductId, n AS row_count, {d('q')} AS Quantity, {d('s')} AS Subtotal,
       {d('t')} AS Total, {d('x')} AS TaxTotal, {exact_mean('w', 'qi')} AS UnitPrice,
       c = '' OR p = '' AS has_error
FROM g""")
def key_totals(spark, sf_dir):
    return bk.key_totals(feeds.frame(spark, sf_dir, feeds.LEFT))


@query(result_sql(keys_sql()))
def compare_business_key(spark, sf_dir):
    return bk.compare_business_keys(*business(spark, sf_dir), OPTIONS)


@query(result_sql(keys_sql(), f"st = '{MISSING_LEFT}'"))
def compare_right_only(spark, sf_dir):
    return bk.compare_business_keys(*business(spark, sf_dir), OPTIONS).where(F.col("Status") == MISSING_LEFT)


@query(f"""{keys_sql()}
SELECT c AS CustomerDomainName, p AS ProductId, st AS Status,
       CAST(row_number() OVER (ORDER BY CASE WHEN st = '{MISSING_LEFT}' THEN 1 ELSE 0 END, c, p) AS BIGINT) AS place
FROM j WHERE st IS NOT NULL""")
def result_order(spark, sf_dir):
    """The ordered result, its order taken from the files it is written to."""
    result = bk.compare_business_keys(*business(spark, sf_dir), OPTIONS).select(*bk.KEYS, "Status")
    ordered = bk.order_result(staging.written(result, "result"), OPTIONS)  # sorting samples and reads it
    rows = sources.scan_csv(spark, as_csv(ordered))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("_file").agg(F.max("_row").alias("n"))  # one row per file
    before = files.select("_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(before, "_file").select(*bk.KEYS, "Status", (F.col("before") + F.col("_row")).alias("place"))


@query(result_sql(keys_sql(), f"st <> '{MISSING_LEFT}'"))
def compare_hide_right_only(spark, sf_dir):
    return bk.compare_business_keys(*business(spark, sf_dir), replace(OPTIONS, hide_right_only=True))


@query(result_sql(keys_sql(), "NOT ex"))
def excluded_tenants(spark, sf_dir):
    return bk.compare_business_keys(*business(spark, sf_dir), replace(OPTIONS, drop_excluded=True))


@query(result_sql(keys_sql("trim(PartnerId) <> ''")))
def partner_slice(spark, sf_dir):
    return bk.compare_business_keys(*pair(spark, sf_dir, feeds.LEFT, feeds.RIGHT), OPTIONS)


LARGE = """
SELECT concat('c', l_suppkey % 7) AS CustomerDomainName, concat('p', l_orderkey % 11) AS ProductId,
       CASE WHEN l_orderkey % 11 = 0 AND l_suppkey % 7 = {part} THEN '1E33' ELSE '1' END AS Quantity,
       CASE WHEN l_orderkey % 11 = 1 THEN '90000000000000000000000000000000' WHEN l_orderkey % 11 = 2 THEN '{sign}9E31'
            ELSE '250000000000000.25' END AS Total,
       CASE WHEN l_linenumber = 7 THEN '1E15' ELSE '-3.5' END AS Subtotal, '0' AS TaxTotal
FROM {{lineitem}} WHERE {where}"""
LARGE_LEFT = LARGE.format(part=3, sign="", where="l_orderkey % 11 <> 2 OR l_linenumber = 1")
LARGE_RIGHT = LARGE.format(part=3, sign="-", where="l_orderkey % 11 <> 2 OR l_linenumber = 1")


def large_side(text: str) -> str:
    return f"""SELECT upper(CustomerDomainName) AS c, upper(ProductId) AS p, count(*) AS n, bool_or(Quantity = '1E33') AS over,
       sum(CASE WHEN Total LIKE '9%' THEN 900000000 WHEN Total LIKE '-9%' THEN -900000000 ELSE 0 END) AS parts,
       sum(CASE WHEN Total LIKE '2%' THEN 25000000000000025::HUGEINT ELSE 0 END) AS cents,
       sum(CASE WHEN Subtotal = '1E15' THEN 10000000000000000::HUGEINT / 10 ELSE -35 END) AS tenths
FROM ({feeds.sql(text)}) f GROUP BY 1, 2"""


@query(f"""WITH l AS ({large_side(LARGE_LEFT)}), r AS ({large_side(LARGE_RIGHT)}),
j AS (SELECT l.c, l.p, l.n AS ln, l.parts AS lp, r.parts AS rp, l.over OR r.over OR abs(l.parts) >= 1000000000 OR abs(r.parts) >= 1000000000 AS lost,
             l.cents AS lc FROM l JOIN r ON l.c = r.c AND l.p = r.p)
SELECT c AS CustomerDomainName, p AS ProductId,
       CASE WHEN lost THEN '{fixed.DATA_ERROR}' WHEN lp = rp THEN '{fixed.MATCHED}' ELSE '{fixed.MISMATCHED}' END AS Status,
       CASE WHEN lost THEN 'Amount out of range' WHEN lp = rp THEN '' ELSE 'Total:' || CASE WHEN lp > rp THEN '+' ELSE '' END
            || (lp - rp)::HUGEINT || '00000000000000000000000' END AS MismatchDetails,
       CAST(CASE WHEN lp = 0 THEN (lc // 100)::VARCHAR || '.' || lpad((lc % 100)::VARCHAR, 2, '0') END AS DOUBLE) AS {HUB}Total
FROM j""")
def large_amounts(spark, sf_dir):
    """Amounts and totals at the border of what can be held: reported, never read as 0 or ended by an error."""
    left, right = pair(spark, sf_dir, LARGE_LEFT, LARGE_RIGHT)
    shown = bk.compare_business_keys(left, right)
    total = F.col(f"{HUB}Total")
    cents = F.col("ProductId").isin("P1", "P2")
    return shown.select(*bk.KEYS, "Status", "MismatchDetails", F.when(~cents, total.cast("double")).alias(f"{HUB}Total"))


def summary_sql(keys: str) -> str:
    def n(cond: str) -> str:
        return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"
    return f"""{keys}, m AS (
  SELECT {n(f"st = '{fixed.MATCHED}'")} AS matched, {n(f"st = '{MISSING_RIGHT}'")} AS missing_right,
         {n(f"st = '{MISSING_LEFT}'")} AS missing_left, {n(f"st = '{fixed.MISMATCHED}'")} AS mismatched,
         {n(f"st = '{fixed.DATA_ERROR}'")} AS data_errors, {n("ln > 0 AND NOT blank")} AS total_keys,
         {n("ex AND ln > 0 AND NOT blank")} AS skipped, {n("ln > 1 AND NOT blank")} AS duplicates
  FROM j)
SELECT *, total_keys - skipped AS reported,
       'Matched: ' || matched || ' | {MISSING_RIGHT}: ' || missing_right || ' | {MISSING_LEFT}: ' || missing_left
       || ' | Mismatched: ' || mismatched || ' | Data Errors: ' || data_errors
       || ' | Total unique {L} keys: ' || total_keys || '; Reported: ' || (total_keys - skipped)
       || '; Skipped: ' || skipped || '; Duplicates: ' || duplicates AS summary
FROM m"""


@query(summary_sql(keys_sql()))
def compare_summary(spark, sf_dir):
    return bk.summarise(grouped(spark, sf_dir), OPTIONS)


@query(f"""{keys_sql()}
SELECT c AS CustomerDomainName, p AS ProductId, ln AS n, CASE WHEN ln > 5 THEN 'ERROR' ELSE 'WARN' END AS level
FROM j WHERE ln > 1 AND NOT blank""")
def duplicate_keys(spark, sf_dir):
    return bk.duplicate_keys(grouped(spark, sf_dir))


@query(f"""{keys_sql()}
SELECT c AS CustomerDomainName, p AS ProductId,
       CASE WHEN rn = 0 THEN 'left' WHEN ln = 0 THEN 'right' ELSE 'both' END AS presence
FROM j WHERE NOT blank""")
def key_overlap(spark, sf_dir):
    return bk.key_presence(grouped(spark, sf_dir))


@query(f"""{keys_sql()}
SELECT CAST(count(*) FILTER (WHERE ln > 0) AS BIGINT) AS left_keys,
       CAST(count(*) FILTER (WHERE rn > 0) AS BIGINT) AS right_keys,
       CAST(count(*) FILTER (WHERE ln > 0 AND rn > 0) AS BIGINT) AS overlap
FROM j WHERE NOT blank""")
def key_counts(spark, sf_dir):
    return bk.key_counts(grouped(spark, sf_dir))


@query(f"""{keys_sql()}
SELECT c AS CustomerDomainName, p AS ProductId FROM j WHERE NOT blank AND ln > 0 AND rn > 0 ORDER BY c, p LIMIT 10""")
def overlap_sample(spark, sf_dir):
    return bk.overlap_sample(grouped(spark, sf_dir))


@query(f"""{keys_sql()}
SELECT c AS CustomerDomainName, p AS ProductId FROM j WHERE NOT blank AND ln > 0 AND rn = 0""")
def missing_keys(spark, sf_dir):
    return bk.keys_missing_right(grouped(spark, sf_dir))


@query(f"""{keys_sql()}
SELECT c AS CustomerDomainName, p AS ProductId FROM j WHERE ex AND ln > 0 AND NOT blank""")
def skipped_keys(spark, sf_dir):
    return bk.skipped_keys(grouped(spark, sf_dir))


@query(f"""{keys_sql()}
SELECT c AS CustomerDomainName, p AS ProductId, 'Skipped' AS Issue FROM j WHERE ex AND ln > 0 AND NOT blank
UNION ALL
SELECT c, p, 'Duplicate x' || ln FROM j WHERE ln > 1 AND NOT blank""")
def key_diagnostics(spark, sf_dir):
    return bk.key_diagnostics(grouped(spark, sf_dir))


@query(f"""{keys_sql()}
SELECT c AS CustomerDomainName, p AS ProductId, {details_sql()} AS MismatchDetails
FROM j WHERE st = '{fixed.MISMATCHED}'""")
def mismatch_details(spark, sf_dir):
    result = bk.compare_business_keys(*business(spark, sf_dir), OPTIONS)
    return result.where(F.col("Status") == fixed.MISMATCHED).select(*bk.KEYS, "MismatchDetails")


@query(f"""SELECT o_orderkey, {signed('CAST(o_totalprice - 200000 AS DECIMAL(18,3)) / 1')} AS delta,
       {short('CAST(o_totalprice AS DECIMAL(18,3))')} AS amount FROM orders""".replace(" / 1", ""))
def signed_delta_text(spark, sf_dir):
    orders = feeds.table("orders")(spark, sf_dir)
    price = F.col("o_totalprice").cast("decimal(18,3)")
    return orders.select("o_orderkey", num.signed(price - 200000).alias("delta"), num.short(price).alias("amount"))


@query(f"""{keys_sql()}
SELECT CAST(count(*) AS BIGINT) AS total_rows,
       CAST(count(*) FILTER (WHERE st <> '{fixed.MATCHED}') AS BIGINT) AS unmatched_groups,
       {d('sum(greatest(lt - rt, 0))')} AS over_bill, {d('sum(greatest(rt - lt, 0))')} AS under_bill
FROM j WHERE NOT ex""")
def over_under_bill(spark, sf_dir):
    return bk.over_under_bill(grouped(spark, sf_dir), OPTIONS)


@query(f"""{keys_sql()}
SELECT c AS CustomerDomainName, p AS ProductId, st AS Status,
       CASE WHEN st IN ('{fixed.MISMATCHED}', '{MISSING_LEFT}', '{MISSING_RIGHT}') AND abs(lt - rt) >= 20
            THEN 'High' ELSE 'Low' END AS Priority
FROM j WHERE st IS NOT NULL""")
def priority(spark, sf_dir):
    options = replace(OPTIONS, high_priority_threshold=20)
    return bk.compare_business_keys(*business(spark, sf_dir), options).select(*bk.KEYS, "Status", "Priority")


def log_sql() -> str:
    pair_text = "c || '|' || p"
    return f"""{keys_sql()}, log AS (
SELECT 'WARN' AS level, 'Key missing in {R}: ' || {pair_text} AS message, 1 AS n FROM j WHERE ln > 0 AND rn = 0 AND NOT blank
UNION ALL SELECT 'WARN', 'Key ' || {pair_text} || ' has missing CustomerDomainName or ProductId', 1
  FROM j WHERE st = '{fixed.DATA_ERROR}' AND NOT ex
UNION ALL SELECT 'WARN', 'Key ' || {pair_text} || ' missing in {R} results', 1 FROM j WHERE st = '{MISSING_RIGHT}'
UNION ALL SELECT 'WARN', 'Key ' || {pair_text} || ' missing in {L} results', 1 FROM j WHERE st = '{MISSING_LEFT}'
UNION ALL SELECT 'WARN', 'Key skipped or filtered: ' || {pair_text}, 1 FROM j WHERE ex AND ln > 0 AND NOT blank
UNION ALL SELECT 'WARN', 'Excluded tenant ' || c, sum(ln + rn) FROM j WHERE ex GROUP BY c
UNION ALL (SELECT 'INFO', 'Key matched: ' || {pair_text}, 1 FROM j WHERE ln > 0 AND rn > 0 AND NOT blank ORDER BY c, p LIMIT 10)
UNION ALL (SELECT CASE WHEN ln > 5 THEN 'ERROR' ELSE 'WARN' END, 'Duplicate ' || {pair_text} || ' appears ' || ln || ' times', 1
  FROM j WHERE ln > 1 AND NOT blank ORDER BY c, p LIMIT 5)
UNION ALL SELECT 'INFO', '{L} unique keys: ' || count(*), 1 FROM j WHERE ln > 0 AND NOT blank
UNION ALL SELECT 'INFO', '{R} unique keys: ' || count(*), 1 FROM j WHERE rn > 0 AND NOT blank
UNION ALL SELECT 'INFO', 'Overlap: ' || count(*) || '.', 1 FROM j WHERE ln > 0 AND rn > 0 AND NOT blank
UNION ALL SELECT 'WARN', 'Duplicate {L} keys: ' || count(*), 1 FROM j WHERE ln > 1 AND NOT blank HAVING count(*) > 0
UNION ALL SELECT 'INFO', 'Aggregated {L} keys: ' || count(*) FILTER (WHERE ln > 0) || '; {R} keys: '
  || count(*) FILTER (WHERE rn > 0), 1 FROM j WHERE NOT ex)
"""


@query(log_sql() + "SELECT level, message, CAST(n AS BIGINT) AS occurrences FROM log")
def run_log(spark, sf_dir):
    return bk.run_log(bk.held_keys(grouped(spark, sf_dir)), OPTIONS)


@query(log_sql() + "SELECT level, CAST(sum(n) AS BIGINT) AS n FROM log GROUP BY level")
def run_log_levels(spark, sf_dir):
    return fi.counts_by_level(bk.run_log(bk.held_keys(grouped(spark, sf_dir)), OPTIONS), "occurrences")


# --- Net price comparison ----------------------------------------------------------------


def net_sql(columns: str, extra: str = "") -> str:
    def side(text: str, plan: str) -> str:
        return f"""SELECT upper(trim(CustomerDomainName)) AS c, upper(trim(ProductId)) AS p,
       sum(Quantity) AS q, sum(Subtotal) AS s,
       string_agg(DISTINCT ChargeType, ', ' ORDER BY ChargeType) AS charges
FROM ({feeds.sql(text)}) feed WHERE lower({plan}) <> 'azure plan' GROUP BY 1, 2"""
    return f"""WITH l AS ({side(feeds.LEFT, 'ProductName')}), r AS ({side(feeds.RIGHT, 'SubscriptionDescription')})
SELECT l.c AS CustomerDomainName, l.p AS ProductId, {columns}
FROM l JOIN r ON l.c = r.c AND l.p = r.p WHERE (abs(l.q - r.q) > 0.01 OR abs(l.s - r.s) > 0.01) {extra}"""


@query(net_sql(f"""l.charges AS ChargeType, {d('l.q')} AS {HUB}Quantity, {d('r.q')} AS {MS}Quantity,
       {d('l.s')} AS {HUB}Subtotal, {d('r.s')} AS {MS}Subtotal, {d('l.q - r.q')} AS QuantityDiff,
       {d('l.s - r.s')} AS PriceDiff"""))
def net_price_mismatch(spark, sf_dir):
    return npx.net_price_mismatches(*business(spark, sf_dir), OPTIONS)


@query(net_sql("l.charges AS ChargeType", "AND l.charges LIKE '%,%'"))
def charge_types_concat(spark, sf_dir):
    found = npx.net_price_mismatches(*business(spark, sf_dir), OPTIONS)
    return found.where(F.col("ChargeType").contains(",")).select(*bk.KEYS, "ChargeType")


@query(f"""SELECT 'totals' AS pass, CustomerDomainName, ProductId, Status, HQ AS quantity_gap
FROM ({result_sql(keys_sql())
       .replace('SELECT c AS CustomerDomainName', 'SELECT CASE WHEN ex THEN 0 ELSE ' + d('lq') + f" END - CASE WHEN st = '{fixed.DATA_ERROR}' THEN 0 ELSE " + d('rq') + ' END AS HQ, c AS CustomerDomainName')}) t
UNION ALL
SELECT 'net price', CustomerDomainName, ProductId, 'Mismatched', gap FROM ({net_sql(d('l.q - r.q') + ' AS gap')}) n""")
def two_pass(spark, sf_dir):
    run = runs.compare(*business(spark, sf_dir), OPTIONS)
    gap = F.col(f"{HUB}Quantity").cast("double") - F.col(f"{MS}Quantity").cast("double")
    first = run.result.select(F.lit("totals").alias("pass"), *bk.KEYS, "Status", gap.alias("quantity_gap"))
    second = run.price_mismatches.select(
        F.lit("net price").alias("pass"), *bk.KEYS, F.lit("Mismatched").alias("Status"),
        F.col("QuantityDiff").cast("double").alias("quantity_gap"))
    return first.unionByName(second)


# --- Field comparison -------------------------------------------------------------------------


def lines(spark, sf_dir):
    return pair(spark, sf_dir, feeds.LEFT_LINES, feeds.RIGHT_LINES)


def hot_lines(spark, sf_dir):
    return pair(spark, sf_dir, feeds.LEFT_HOT, feeds.RIGHT_HOT)


def pairs_sql() -> str:
    """Differing fields of all row pairs, by brute force."""
    fields = "\nUNION ALL ".join(
        f"SELECT i, s, '{f}' AS f, l{f} AS a, r{f} AS b FROM p" for f in fixed.DIFF_FIELDS)
    side = ", ".join(f"l.{f} AS l{f}, r.{f} AS r{f}" for f in fixed.DIFF_FIELDS)
    return f"""
WITH l AS (SELECT *, upper(InvoiceNumber) AS i, upper(SkuId) AS s FROM ({feeds.sql(feeds.LEFT_LINES)}) x),
r AS (SELECT *, upper(InvoiceNumber) AS i, upper(SkuId) AS s FROM ({feeds.sql(feeds.RIGHT_LINES)}) x),
p AS (SELECT l.i, l.s, {side} FROM l JOIN r ON l.i = r.i AND l.s = r.s),
cells AS ({fields}),
diff AS (SELECT * FROM cells WHERE
  CASE WHEN TRY_CAST(a AS DECIMAL(18,6)) IS NOT NULL AND TRY_CAST(b AS DECIMAL(18,6)) IS NOT NULL
       THEN abs(TRY_CAST(a AS DECIMAL(18,6)) - TRY_CAST(b AS DECIMAL(18,6))) > 0.01
       ELSE upper(a) <> upper(b) END),
gone AS (
  SELECT coalesce(a.i, b.i) AS i, coalesce(a.s, b.s) AS s,
         CASE WHEN a.i IS NULL THEN '{MISSING_LEFT}' ELSE '{MISSING_RIGHT}' END AS e
  FROM (SELECT DISTINCT i, s FROM l) a FULL JOIN (SELECT DISTINCT i, s FROM r) b ON a.i = b.i AND a.s = b.s
  WHERE a.i IS NULL OR b.i IS NULL)
"""


def sides_sql() -> str:
    """Per side, key, field and value: its rows, and the row pairs in which it differs."""
    def counted(side: str) -> str:
        return "\nUNION ALL ".join(f"SELECT i, s, '{f}' AS f, {f} AS v FROM {side}" for f in fixed.DIFF_FIELDS)
    return pairs_sql() + f""",
ln AS (SELECT i, s, f, v, count(*) AS n FROM ({counted('l')}) GROUP BY i, s, f, v),
rn AS (SELECT i, s, f, v, count(*) AS n FROM ({counted('r')}) GROUP BY i, s, f, v),
ld AS (SELECT i, s, f, a AS v, count(*) AS pairs FROM diff GROUP BY i, s, f, a),
rd AS (SELECT i, s, f, b AS v, count(*) AS pairs FROM diff GROUP BY i, s, f, b),
lone AS (SELECT i, s, '{L}' AS side, e, (SELECT count(*) FROM l WHERE l.i = gone.i AND l.s = gone.s) AS n FROM gone WHERE e = '{MISSING_RIGHT}'
  UNION ALL SELECT i, s, '{R}', e, (SELECT count(*) FROM r WHERE r.i = gone.i AND r.s = gone.s) FROM gone WHERE e = '{MISSING_LEFT}'),
shown AS (
  SELECT i AS InvoiceNumber, s AS SkuId, {friendly('f')} AS "Field Name", '{L}' AS Side, v AS "Our Value", '' AS "{R} Value",
         'Mismatch in ' || f AS Explanation, '' AS "Suggested Action", '' AS Reason, n AS RowCount, pairs AS PairCount FROM ld JOIN ln USING (i, s, f, v)
  UNION ALL SELECT i, s, {friendly('f')}, '{R}', '', v, 'Mismatch in ' || f, '', '', n, pairs FROM rd JOIN rn USING (i, s, f, v)
  UNION ALL SELECT i, s, 'Row', side, i || '|' || s, '', e, '', e, n, CAST(1 AS BIGINT) FROM lone)
"""


@query(sides_sql() + "SELECT * FROM shown")
def field_diff(spark, sf_dir):
    return fd.field_differences(*lines(spark, sf_dir))


@query(pairs_sql() + "SELECT i AS InvoiceNumber, s AS SkuId, e AS Explanation FROM gone")
def field_diff_missing(spark, sf_dir):
    return fd.missing_keys(*lines(spark, sf_dir))


@query(pairs_sql() + """, n AS (SELECT (SELECT count(*) FROM diff) + (SELECT count(*) FROM gone) AS n)
SELECT CAST(n AS BIGINT) AS discrepancies, 'Discrepancies found: ' || n AS summary FROM n""")
def field_diff_count(spark, sf_dir):
    return fd.discrepancy_count(*lines(spark, sf_dir))


def hot_sql() -> str:
    """Per key, field and distinct value: rows and differing pairs of either side, by sliding counts."""
    fields = ("Quantity", "Subtotal", "TaxTotal")

    def cells(text: str) -> str:
        return "\nUNION ALL ".join(
            f"SELECT upper(InvoiceNumber) AS i, upper(SkuId) AS s, '{f}' AS f, {f} AS shown FROM ({feeds.sql(text)}) x"
            for f in fields)
    return f"""
WITH held AS (
  SELECT i, s, f, shown, TRY_CAST(shown AS DECIMAL(18,6)) AS v, sum(ln) AS ln, sum(rn) AS rn FROM (
    SELECT *, 1 AS ln, 0 AS rn FROM ({cells(feeds.LEFT_HOT)}) UNION ALL SELECT *, 0, 1 FROM ({cells(feeds.RIGHT_HOT)}))
  GROUP BY i, s, f, shown),
totals AS (SELECT i, s, f, sum(ln) AS lt, sum(rn) AS rt FROM held GROUP BY i, s, f),
near AS (
  SELECT *, sum(rn) OVER w AS req, sum(ln) OVER w AS leq FROM held
  WINDOW w AS (PARTITION BY i, s, f ORDER BY v RANGE BETWEEN 0.010000 PRECEDING AND 0.010000 FOLLOWING)),
counted AS (
  SELECT i, s, f, shown, CAST(ln AS BIGINT) AS ln, CAST(rn AS BIGINT) AS rn, CAST(rt AS BIGINT) AS rt,
         CAST(ln * (rt - req) AS BIGINT) AS lp, CAST(rn * (lt - leq) AS BIGINT) AS rp
  FROM near JOIN totals USING (i, s, f))
"""


@query(hot_sql() + """
SELECT i AS InvoiceNumber, s AS SkuId, f AS "Field", CAST(sum(ln) AS BIGINT) AS left_rows, max(rt) AS right_rows,
       CAST(sum(lp) AS BIGINT) AS pairs
FROM counted GROUP BY i, s, f HAVING sum(lp) > 0""")
def field_diff_hot_keys(spark, sf_dir):
    return fd.difference_counts(*hot_lines(spark, sf_dir))


@query(hot_sql() + f"""
SELECT i AS InvoiceNumber, s AS SkuId, {friendly('f')} AS "Field Name", '{L}' AS Side, shown AS "Our Value", '' AS "{R} Value",
       'Mismatch in ' || f AS Explanation, '' AS "Suggested Action", '' AS Reason, ln AS RowCount, lp AS PairCount FROM counted WHERE lp > 0
UNION ALL SELECT i, s, {friendly('f')}, '{R}', '', shown, 'Mismatch in ' || f, '', '', rn, rp FROM counted WHERE rp > 0""")
def field_diff_by_value(spark, sf_dir):
    return fd.field_differences(*hot_lines(spark, sf_dir))


@query(sides_sql() + """SELECT InvoiceNumber, SkuId, "Field Name", Side, "Our Value" FROM shown WHERE lower(Explanation) LIKE '%in tot%'""")
def diff_search(spark, sf_dir):
    found = fi.search(fd.field_differences(*lines(spark, sf_dir)), "in Tot")
    return found.select(*fd.KEYS, "Field Name", "Side", "Our Value")


# --- Positional comparison ---------------------------------------------------------------------


def positions(spark, sf_dir):
    def numbered(text: str) -> DataFrame:
        feed = feeds.frame(spark, sf_dir, text)
        return ordinals.bucketed_ordinals(feed, ["position"]).drop("position")
    return numbered(feeds.LEFT_POSITIONS), numbered(feeds.RIGHT_POSITIONS)


def positional_sql() -> str:
    columns = ("SkuId", "Quantity", "OrderDate", "Amount", "PerDayUnitPrice", "Note")
    cells = "\nUNION ALL ".join(
        f"SELECT l.n, '{c}' AS col, l.{c} AS a, r.{c} AS b FROM l JOIN r USING (n)" for c in columns)
    amount = "TRY_CAST(trim({0}) AS DECIMAL(18,6))"
    date = ("COALESCE(TRY_CAST(try_strptime({0}, '%m/%d/%Y') AS DATE), "
            "CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST({0} AS DATE) END)")
    us = "month({0}) || '/' || day({0}) || '/' || year({0})"
    shown = f"CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN {{0}} ELSE {{1}} END"
    return f"""
WITH l AS (SELECT *, row_number() OVER (ORDER BY position) AS n FROM ({feeds.sql(feeds.LEFT_POSITIONS)}) x),
r AS (SELECT *, row_number() OVER (ORDER BY position) AS n FROM ({feeds.sql(feeds.RIGHT_POSITIONS)}) x),
cells AS ({cells}),
typed AS (SELECT *, {amount.format('a')} AS da, {amount.format('b')} AS db, {date.format('a')} AS ta, {date.format('b')} AS tb,
                 {friendly('col')} AS name FROM cells),
diff AS (
  SELECT n, col, name, coalesce({short('da')}, a) AS a, coalesce({short('db')}, b) AS b,
         CASE WHEN da IS NOT NULL AND db IS NOT NULL
              THEN 'Numeric mismatch in ' || name || ': ' || {short('da')} || ' vs ' || {short('db')}
              WHEN ta IS NOT NULL AND tb IS NOT NULL
              THEN 'Date mismatch in ' || name || ': ' || {us.format('ta')} || ' vs ' || {us.format('tb')}
              ELSE 'Text mismatch in ' || name || ': ''' || a || ''' vs ''' || b || '''' END AS e,
         CASE lower(col) WHEN 'skuid' THEN 'Product Code mismatches' WHEN 'quantity' THEN 'Quantity mismatches'
              WHEN 'orderdate' THEN 'Date mismatches' ELSE 'Other mismatches' END AS g
  FROM typed
  WHERE CASE WHEN da IS NOT NULL AND db IS NOT NULL
             THEN abs(da - db) > CASE WHEN col = 'PerDayUnitPrice' THEN 0.05 ELSE 0.01 END
             WHEN ta IS NOT NULL AND tb IS NOT NULL THEN ta <> tb
             ELSE upper(trim(a)) <> upper(trim(b)) END
  UNION ALL
  SELECT coalesce(l.n, r.n), '', '', '', '', CASE WHEN l.n IS NULL THEN 'Row missing in left table'
                                             ELSE 'Row missing in right table' END, '{fixed.MISSING_ROWS}'
  FROM l FULL JOIN r ON l.n = r.n WHERE l.n IS NULL OR r.n IS NULL)
"""


@query(positional_sql() + f"""
SELECT CAST(n AS BIGINT) AS "Row Number", col AS "Column", name AS "Field Name", a AS "Our Value", b AS "{R} Value", e AS Explanation,
       CASE g WHEN 'Product Code mismatches' THEN 'Please verify the correct product was invoiced.'
              WHEN 'Date mismatches' THEN 'Review and confirm correct invoice date.'
              WHEN 'Quantity mismatches' THEN 'Investigate reason for quantity difference.' ELSE '' END AS "Suggested Action",
       g AS "Group" FROM diff""")
def positional_diff(spark, sf_dir):
    return pdiff.positional_differences(*positions(spark, sf_dir))


@query(positional_sql() + """SELECT g AS "Group", CAST(count(*) AS BIGINT) AS n FROM diff GROUP BY g""")
def positional_groups(spark, sf_dir):
    return pdiff.group_counts(pdiff.positional_differences(*positions(spark, sf_dir)))


@query(positional_sql() + """, g AS (SELECT g, count(*) AS n FROM diff GROUP BY g)
SELECT CAST(greatest((SELECT count(*) FROM l), (SELECT count(*) FROM r)) AS BIGINT) AS rows_compared,
       CAST((SELECT count(*) FROM diff) AS BIGINT) AS discrepancies,
       'Summary: ' || (SELECT string_agg(n || ' ' || g, ', ' ORDER BY n || ' ' || g) FROM g) AS summary""")
def positional_summary(spark, sf_dir):
    left, right = positions(spark, sf_dir)
    return pdiff.summarise_positional(left, right, pdiff.positional_differences(left, right))


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS "Row Number" FROM orders""")
def running_row_number(spark, sf_dir):
    orders = feeds.table("orders")(spark, sf_dir).select("o_orderdate", "o_orderkey")
    return ordinals.running_number(orders, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "Row Number")


# --- Invoice rules --------------------------------------------------------------------------------


def invoice(spark, sf_dir):
    return feeds.frame(spark, sf_dir, feeds.INVOICE)


DAYS, PARTNER_D, HIERARCHY, PRICING = fixed.INVOICE_CHECKS.values()


def rules_sql(feed: str = feeds.INVOICE) -> str:
    amount = "CAST({0} AS DECIMAL(18,6))"
    pct, cust = short("pd"), short("cd")
    return f"""
WITH f AS (SELECT *, date_diff('day', CAST(ChargeStartDate AS DATE), CAST(ChargeEndDate AS DATE)) + 1 AS days,
                  CAST(EffectiveDays AS INT) AS eff, {amount.format('MSRP')} AS ms,
                  {amount.format('PartnerDiscountPercentage')} AS pd, {amount.format('CustomerDiscountPercentage')} AS cd,
                  {amount.format('Total')} AS tot, {amount.format('CustomerSubtotal')} AS sub
           FROM ({feeds.sql(feed)}) x),
v AS (SELECT *,
  CASE WHEN days <> eff THEN 'Mismatch: Expected EffectiveDays is ' || days || ' days, but found ' || eff || ' days.' END AS e1,
  CASE WHEN ms > 5 AND pd <= 0 THEN 'Invalid: MSRP (' || {short('ms')} || ') is greater than 5, but PartnerDiscountPercentage is ' || {pct} || '%.'
       WHEN ms > 5 AND (round(pd, 1) < 18.0 OR round(pd, 1) > 20.1)
       THEN 'Invalid: PartnerDiscountPercentage (' || {pct} || '%) is not between 18% and 20.1%.' END AS e2,
  CASE WHEN cd < 100 AND pd < cd THEN 'Invalid: PartnerDiscountPercentage (' || {pct} || '%) is less than CustomerDiscountPercentage (' || {cust} || '%).' END AS e3,
  CASE WHEN NOT (sub = 0 AND cd >= 100) AND abs(tot) > abs(sub)
       THEN 'Invalid: PartnerTotal (' || {short('tot')} || ') is greater than CustomerSubTotal (' || {short('sub')} || ').' END AS e4
  FROM f)
"""


_INVOICE_COLUMNS = """InvoiceNumber, SkuId, ChargeStartDate, ChargeEndDate, EffectiveDays, MSRP, PartnerDiscountPercentage,
       CustomerDiscountPercentage, Total, CustomerSubtotal"""


@query(rules_sql() + f"""
SELECT {_INVOICE_COLUMNS}, e1 AS "{DAYS}", e2 AS "{PARTNER_D}", e3 AS "{HIERARCHY}", e4 AS "{PRICING}"
FROM v WHERE coalesce(e1, e2, e3, e4) IS NOT NULL""")
def invoice_rules(spark, sf_dir):
    return ir.invalid_rows(invoice(spark, sf_dir))


@query(rules_sql(feeds.INVOICE_BOUNDS) + f"""
SELECT {_INVOICE_COLUMNS}, e1 AS "{DAYS}", e2 AS "{PARTNER_D}", e3 AS "{HIERARCHY}", e4 AS "{PRICING}"
FROM v WHERE coalesce(e1, e2, e3, e4) IS NOT NULL""")
def invoice_discount_bounds(spark, sf_dir):
    """Discounts of zero and below, and some that only rounding puts inside the bounds or outside."""
    return ir.invalid_rows(feeds.frame(spark, sf_dir, feeds.INVOICE_BOUNDS))


@query(rules_sql() + """
SELECT CAST(count(e1) + count(e2) AS BIGINT) AS high, CAST(count(e3) + count(e4) AS BIGINT) AS low,
       'High: ' || (count(e1) + count(e2)) || '  Low: ' || (count(e3) + count(e4)) AS summary FROM v""")
def invoice_rule_counts(spark, sf_dir):
    return ir.severity_counts(invoice(spark, sf_dir))


@query(rules_sql() + f"""
SELECT {_INVOICE_COLUMNS}, e1 AS "{DAYS}", e2 AS "{PARTNER_D}", e3 AS "{HIERARCHY}", e4 AS "{PRICING}", 'High' AS severity
FROM v WHERE coalesce(e1, e2) IS NOT NULL""")
def invoice_high_only(spark, sf_dir):
    return ir.high_priority_only(ir.invalid_rows(invoice(spark, sf_dir)))


@query(rules_sql() + f"""
SELECT "check", severity, message, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT '{DAYS}' AS "check", 'High' AS severity, e1 AS message FROM v
  UNION ALL SELECT '{PARTNER_D}', 'High', e2 FROM v
  UNION ALL SELECT '{HIERARCHY}', 'Low', e3 FROM v
  UNION ALL SELECT '{PRICING}', 'Low', e4 FROM v) x WHERE message IS NOT NULL GROUP BY 1, 2, 3""")
def invoice_violations(spark, sf_dir):
    found = ir.violations(invoice(spark, sf_dir))
    return found.groupBy("check", "severity", "message").agg(F.count(F.lit(1)).alias("n"))


@query(rules_sql() + f"""
SELECT 'Warning' AS level, 'customerDiscountPercentage' AS "column",
       'Customer at 100% discount – hierarchy check skipped.' AS description, {short('cd')} AS raw_value,
       CAST(count(*) AS BIGINT) AS n FROM v WHERE cd >= 100 GROUP BY 4
UNION ALL
SELECT 'Warning', 'customerSubtotal', 'Customer billed $0 due to 100% discount – consistency check skipped.',
       {short('sub')}, CAST(count(*) AS BIGINT) FROM v WHERE cd >= 100 AND sub = 0 GROUP BY 4""")
def invoice_skip_findings(spark, sf_dir):
    found = ir.skip_findings(invoice(spark, sf_dir))
    return found.groupBy("level", "column", "description", "raw_value").agg(F.count(F.lit(1)).alias("n"))


# --- Data quality and findings --------------------------------------------------------------------


def quality(spark, sf_dir):
    return feeds.frame(spark, sf_dir, feeds.QUALITY)


def quality_sql() -> str:
    """All row findings by one select per rule and column."""
    priced = [c for c in fixed.PRICED_COLUMNS if c != "CustomerEffectiveUnitPrice"]
    amount = "coalesce(TRY_CAST({0} AS DECIMAL(18,6)), 0)"

    def rule(level, name, column, description, raw, condition):
        return (f"SELECT '{level}' AS level, '{name}' AS rule, '{column}' AS col, {description} AS description, "
                f"trim({raw}) AS raw_value, context FROM f WHERE {condition}")
    parts = [
        rule("Warning", "Q1", c, "'Value is 0 or blank while Quantity is ' || Quantity", c,
             f"qty > 0 AND {amount.format(c)} = 0") for c in priced
    ]
    pdp = amount.format("PartnerDiscountPercentage")
    parts.append(rule("Error", "Q2a", "PartnerDiscountPercentage", "'Discount percentage out of bounds (0-100)'",
                      "PartnerDiscountPercentage", f"({pdp} < 0 OR {pdp} > 100)"))
    parts.append(rule("Warning", "Q2b", "PartnerDiscountPercentage", "'Suspicious discount (<1% or >90%)'",
                      "PartnerDiscountPercentage", f"NOT ({pdp} < 0 OR {pdp} > 100) AND ({pdp} < 1 OR {pdp} > 90)"))
    parts.append(rule("Error", "Q3", "-", "'All pricing fields zero or blank while Quantity not zero'", "''",
                      "qty > 0 AND " + " AND ".join(f"{amount.format(c)} = 0" for c in priced)))
    parts.append(rule("Error", "Q4", "OrderDate", "'Invalid date format'", "OrderDate", "OrderDate LIKE 'due%'"))
    for c in ("PartnerTaxTotal", "CustomerSubTotal"):
        parts.append(rule("Warning", "Q5", c, "'Negative total value'", c, f"{amount.format(c)} < 0"))
    return f"""
WITH f AS (SELECT *, CAST(Quantity AS INT) AS qty,
                  'Customer: ' || CASE WHEN trim(CustomerName) = '' THEN '(missing)' ELSE CustomerName END
                  || ', SKU: ' || SkuId AS context FROM ({feeds.sql(feeds.QUALITY)}) x),
found AS ({chr(10).join(' UNION ALL '.join(parts).splitlines())})
"""


def blanks_sql() -> str:
    columns = ("CustomerSubTotal", "Quantity", "PartnerDiscountPercentage")
    return ", rates AS (" + "\nUNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS col, count(*) FILTER (WHERE coalesce(TRY_CAST({c} AS DECIMAL(18,6)), 0) = 0) AS affected, "
        "count(*) AS total_rows FROM f" for i, c in enumerate(columns)) + ")"


@query(quality_sql() + """SELECT level, rule, col AS "column", description, raw_value, context FROM found""")
def dq_findings(spark, sf_dir):
    return dq.row_findings(quality(spark, sf_dir)).drop("row", "file_name", "is_summary")


@query(quality_sql() + blanks_sql() + """
SELECT 'Warning' AS level, 'Q6' AS rule, CAST(-1 AS BIGINT) AS "row", col AS "column",
       'More than ' || CAST(floor(100 * affected / total_rows) AS INT) || '% of rows have zero or blank values in column ' || col
         AS description, '' AS raw_value, 'feed' AS file_name, '' AS context, false AS is_summary
FROM rates WHERE affected > 0.1 * total_rows""".replace("100 * affected / total_rows", "100 * affected // total_rows"))
def dq_blank_rates(spark, sf_dir):
    return dq.blank_rate_findings(quality(spark, sf_dir), "feed")


@query(quality_sql() + blanks_sql() + """,
s AS (SELECT (SELECT count(*) FROM f) AS total_rows,
  (SELECT count(*) FROM found WHERE level = 'Error') AS errors,
  (SELECT count(*) FROM found WHERE level = 'Warning')
    + (SELECT count(*) FROM rates WHERE affected > 0.1 * total_rows) AS warnings,
  (SELECT description FROM found WHERE level = 'Error' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_error,
  (SELECT string_agg(col || ': ' || affected || '/' || total_rows, '; ' ORDER BY position) FROM rates
   WHERE affected > 0.1 * total_rows) AS blank_columns)
SELECT CAST(total_rows AS BIGINT) AS total_rows, CAST(errors AS BIGINT) AS errors, CAST(warnings AS BIGINT) AS warnings,
       top_error, blank_columns,
       'Total rows: ' || total_rows || chr(10) || 'Errors: ' || errors || chr(10) || 'Warnings: ' || warnings || chr(10)
       || 'Most common error: ' || top_error || chr(10) || 'Columns with blanks >10%: ' || blank_columns AS summary
FROM s""")
def dq_summary(spark, sf_dir):
    return dq.feed_summary(quality(spark, sf_dir))


@query(quality_sql() + """
SELECT description, CAST(count(*) AS BIGINT) AS n FROM found WHERE level = 'Error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def dq_top_error(spark, sf_dir):
    return dq.most_common_error(dq.row_findings(quality(spark, sf_dir)))


@query(quality_sql() + """
SELECT level, col AS "column", description, raw_value, context, false AS is_summary FROM (
  SELECT *, row_number() OVER (PARTITION BY level, col, description ORDER BY raw_value, context) AS k FROM found) x WHERE k <= 5
UNION ALL
SELECT level, col, (count(*) - 5) || ' additional rows had the same error: ' || description, '', '', true
FROM found GROUP BY level, col, description HAVING count(*) > 5""")
def findings_topn(spark, sf_dir):
    return fi.cap_per_group(dq.row_findings(quality(spark, sf_dir))).drop("rule", "row", "file_name")


@query(quality_sql() + "SELECT level, description, CAST(count(*) AS BIGINT) AS n FROM found GROUP BY 1, 2")
def findings_counts(spark, sf_dir):
    return fi.counts_by_description(dq.row_findings(quality(spark, sf_dir)))


@query(quality_sql() + "SELECT level, CAST(count(*) AS BIGINT) AS n FROM found GROUP BY 1")
def findings_levels(spark, sf_dir):
    return fi.counts_by_level(dq.row_findings(quality(spark, sf_dir)))


@query(quality_sql() + f"""
SELECT level AS ErrorLevel, '' AS RowNumber, {friendly('col')} AS ColumnName, description AS Description,
       coalesce({short('TRY_CAST(raw_value AS DECIMAL(18,6))')}, raw_value) AS RawValue, '' AS FileName, context AS Context
FROM found WHERE level = 'Error'""")
def findings_report(spark, sf_dir):
    found = fi.of_level(dq.row_findings(quality(spark, sf_dir)), "Error")
    return sinks.findings_report(found).drop("Timestamp")


# --- Cell normalisation -------------------------------------------------------------------------------


@query("""
SELECT c_custkey, 'A b ' || c_mktsegment AS cleaned, c_custkey || 'x' AS no_zeros, upper(c_name) AS key_text,
       upper(c_mktsegment) AS clean_key, CASE WHEN c_nationkey = 0 THEN '(missing)' ELSE c_name END AS shown,
       c_nationkey = 0 AS blank
FROM customer""")
def normalise_text(spark, sf_dir):
    customer = feeds.table("customer")(spark, sf_dir)
    dirty = F.concat(F.lit(" \tA \u0007\t b\n"), F.col("c_mktsegment"), F.lit("\u0000 "))
    padded = F.concat(F.lit("000"), F.col("c_custkey").cast("string"), F.lit("x"))
    sometimes = F.when(F.col("c_nationkey") == 0, F.lit(" \t")).otherwise(F.col("c_name"))
    return customer.select(
        "c_custkey",
        tx.collapse_spaces(tx.clean(dirty)).alias("cleaned"),
        # A zero key is all zeros before the letter.
        F.when(F.col("c_custkey") == 0, F.concat(F.lit("0"), tx.strip_leading_zeros(padded)))
        .otherwise(tx.strip_leading_zeros(padded)).alias("no_zeros"),
        tx.key(F.concat(F.lit("  "), F.lower("c_name"), F.lit("\t"))).alias("key_text"),
        tx.clean_key(F.concat(F.lit("\u0002 "), F.lower("c_mktsegment"), F.lit(" "))).alias("clean_key"),
        tx.or_missing(sometimes).alias("shown"),
        tx.is_blank(sometimes).alias("blank"),
    )


_AMOUNT_TEXT = "CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR(24))"
NUMBERS = f"""
SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(14,2)) AS price, {_AMOUNT_TEXT} AS plain_text,
       CASE l_linenumber WHEN 1 THEN concat('(', {_AMOUNT_TEXT}, ')') WHEN 2 THEN concat(' ', {_AMOUNT_TEXT}, '- ')
            WHEN 3 THEN concat('+1,', {_AMOUNT_TEXT}) WHEN 4 THEN concat('$', {_AMOUNT_TEXT})
            WHEN 5 THEN concat('00', {_AMOUNT_TEXT}) WHEN 6 THEN concat({_AMOUNT_TEXT}, 'E1') ELSE 'n/a' END AS cell
FROM {{lineitem}}
"""
_THOUSANDS = "CAST('1' || plain_text AS DECIMAL(18,6))"


@query(f"""
SELECT l_orderkey, l_linenumber, cell,
  {d(f'CASE l_linenumber WHEN 1 THEN -price WHEN 2 THEN -price WHEN 3 THEN {_THOUSANDS} WHEN 5 THEN price WHEN 6 THEN price * 10 END')} AS lenient,
  {d(f'CASE l_linenumber WHEN 2 THEN -price WHEN 3 THEN {_THOUSANDS} WHEN 5 THEN price END')} AS rule,
  {d('CASE l_linenumber WHEN 5 THEN price WHEN 6 THEN price * 10 END')} AS money,
  CASE l_linenumber WHEN 1 THEN '-' || plain_text WHEN 2 THEN '-' || plain_text WHEN 3 THEN '1' || plain_text
       WHEN 4 THEN plain_text WHEN 5 THEN plain_text
       WHEN 6 THEN rtrim(rtrim(CAST(price * 10 AS VARCHAR), '0'), '.') END AS normal,
  coalesce({short(f'CASE l_linenumber WHEN 1 THEN -price WHEN 2 THEN -price WHEN 3 THEN {_THOUSANDS} WHEN 5 THEN price WHEN 6 THEN price * 10 END')}, cell) AS shown
FROM ({feeds.sql(NUMBERS)}) x""")
def normalise_number(spark, sf_dir):
    cells = feeds.frame(spark, sf_dir, NUMBERS)
    c = F.col("cell")
    return cells.select(
        "l_orderkey", "l_linenumber", "cell", num.lenient_decimal(c).alias("lenient"),
        num.rule_decimal(c).alias("rule"), num.money_decimal(c).alias("money"), num.number_text(c).alias("normal"),
        num.short_if_number(c).alias("shown"),
    )


_DAY = "CAST(o_orderdate AS DATE)"
DATES = f"""
SELECT o_orderkey, {_DAY} AS day,
       CASE o_orderkey % 7
            WHEN 0 THEN concat(CAST({_DAY} AS VARCHAR(10)), 'T23:59:59.123Z')
            WHEN 1 THEN concat(CAST({_DAY} AS VARCHAR(10)), ' 01:02')
            WHEN 2 THEN concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate))
            WHEN 3 THEN concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate), ' 13:14:15')
            WHEN 4 THEN concat(year(o_orderdate), '/', month(o_orderdate), '/', day(o_orderdate))
            WHEN 5 THEN concat(CAST({_DAY} AS VARCHAR(10)), 'T23:30:00-01:00')
            ELSE concat('13/', month(o_orderdate), '/', year(o_orderdate)) END AS cell
FROM {{orders}}
"""


@query(f"""
SELECT o_orderkey, cell, CASE o_orderkey % 7 WHEN 6 THEN NULL WHEN 5 THEN CAST(day + 1 AS VARCHAR)
                              ELSE CAST(day AS VARCHAR) END AS normal,
       CASE o_orderkey % 7 WHEN 6 THEN 1 - date_diff('day', DATE '0001-01-01', day)
                           WHEN 5 THEN 2 ELSE 1 END AS days_since_order
FROM ({feeds.sql(DATES)}) x""")
def normalise_date(spark, sf_dir):
    cells = feeds.frame(spark, sf_dir, DATES)
    days = dt.inclusive_days(F.col("day"), dt.date_or_lowest(cells, "cell"))
    return cells.select(
        "o_orderkey", "cell", dt.date_text(F.col("cell")).alias("normal"),
        days.cast("long").alias("days_since_order"),
    )


# --- Files ------------------------------------------------------------------------------------------------


def as_csv(feed: DataFrame, folder: str | None = None) -> str:
    """Writes a feed as CSV files to a new folder beside the checkpoints, which all executors share."""
    folder = folder or staging.new_path(feed.sparkSession, "feed")
    writer = feed.write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return folder


def as_numbered_csv(spark: SparkSession, sf_dir: str, text: str) -> str:
    """The same with one file per value of file_no, its rows in the order of l_orderkey, l_linenumber and all other columns.

    What dealt the rows goes when the files are written.
    """
    with staging.shuffles_dropped(spark):
        return as_csv(feeds.numbered_frame(spark, sf_dir, text).drop("file_no"))


def file_no(name: str = "_file") -> Column:
    return F.regexp_extract(name, r"^part-(\d+)", 1).cast("long").alias("file_no")


@query("""
SELECT CAST(count(*) AS BIGINT) AS n, true AS rows_are_dense, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS quantity FROM lineitem""")
def csv_feed_scan(spark, sf_dir):
    rows = sources.scan_csv(spark, as_csv(feeds.frame(spark, sf_dir, feeds.RAW_LEFT)))
    # Rows of a file are numbered 1..n: the largest number, the count and the sum of the numbers agree.
    files = rows.groupBy("_file").agg(
        F.count(F.lit(1)).alias("n"), F.max("_row").alias("last"), F.sum("_row").alias("numbers"),
        F.sum(num.amount(rows, "Quantity")).alias("quantity"))
    dense = (F.col("last") == F.col("n")) & (F.col("numbers") * 2 == F.col("n") * (F.col("n") + 1))
    return files.agg(
        F.sum("n").alias("n"), F.bool_and(dense).alias("rows_are_dense"),
        F.sum("quantity").cast("long").alias("quantity"))


@query(f"""
SELECT file_no, CAST(row_number() OVER (PARTITION BY file_no ORDER BY l_orderkey, l_linenumber, Note, Price) AS BIGINT) AS row_no,
       CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, Note, Price
FROM ({feeds.sql(feeds.NOTES)}) x""")
def csv_quoted_cells(spark, sf_dir):
    """Quotes, commas and line breaks in cells, with the row number of every record."""
    rows = sources.scan_csv(spark, as_numbered_csv(spark, sf_dir, feeds.NOTES))
    return rows.select(file_no(), F.col("_row").alias("row_no"), "l_orderkey", "l_linenumber", "Note", "Price")


@query(f"""
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, Note,
       CASE WHEN file_no < 4 THEN Price ELSE '' END AS Price, CASE WHEN file_no < 4 THEN '' ELSE Price END AS Net
FROM ({feeds.sql(feeds.NOTES)}) x""")
def csv_unlike_headers(spark, sf_dir):
    """Two deliveries of one kind: other columns, in another order and spelling."""
    notes, parent = feeds.frame(spark, sf_dir, feeds.NOTES), staging.new_path(spark, "kinds")
    as_csv(notes.where("file_no < 4").drop("file_no"), f"{parent}/G0-1")
    as_csv(notes.where("file_no >= 4").select(
        F.col("Note").alias("note"), F.col("Price").alias("Net"), F.col("l_linenumber").alias(" L_LINENUMBER"), "l_orderkey"), f"{parent}/g0-2")
    rows = sources.scan_kind(spark, parent, fixed.MICROSOFT)
    found = [tx.column(rows, tx.find(rows, n)).alias(n) for n in ("l_orderkey", "l_linenumber", "Note", "Price", "Net")]
    return rows.select(*found)


# --- Reports written as CSV and read back -------------------------------------------------------------


def whole_text(rows: DataFrame) -> list[Column]:
    return [tx.column(rows, c) for c in rows.columns if c not in ("_row", "_file")]


@query(f"""WITH d AS ({SQL["positional_diff"]})
SELECT CAST(row_number() OVER (ORDER BY "Row Number", lower("Column")) AS BIGINT) AS position, CAST("Row Number" AS VARCHAR) AS "Row Number",
       "Field Name", "Our Value", "{R} Value", Explanation, "Suggested Action" FROM d""")
def sink_differences(spark, sf_dir):
    """The ordered report, with each line's place in the whole of its files."""
    left, right = positions(spark, sf_dir)
    diffs, path = pdiff.positional_differences(left, right), staging.new_path(spark, "report")
    sinks.write_differences(diffs, pdiff.summarise_positional(left, right, diffs), path)
    rows = sources.scan_csv(spark, f"{path}/differences")
    files = rows.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("n"))  # one row per file of the report
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(before, rows["_file"] == before["file"]).select((F.col("before") + F.col("_row")).alias("position"), *whole_text(rows))


@query(f"""SELECT level AS "Level", message AS "Message", CAST(occurrences AS VARCHAR) AS "Occurrences" FROM ({SQL["run_log"]}) x""")
def sink_log(spark, sf_dir):
    path = staging.new_path(spark, "report")
    sinks.write_log(bk.run_log(bk.held_keys(grouped(spark, sf_dir)), OPTIONS), path)
    return sources.scan_csv(spark, path).select("Level", "Message", "Occurrences")


@query(SQL["compare_business_key"])
def sink_result(spark, sf_dir):
    path, keys = staging.new_path(spark, "report"), staging.written(grouped(spark, sf_dir), "keys")
    sinks.write_result(bk.result_rows(keys, OPTIONS), path, bk.summarise(keys, OPTIONS), compression="gzip")
    rows = sources.scan_csv(spark, f"{path}/rows")
    text = (*bk.KEYS, "Status", "MismatchDetails")
    return rows.select(*[c if n in text else c.cast("double").alias(n) for c, n in zip(whole_text(rows), rows.columns)])


# --- Imports --------------------------------------------------------------------------------------------


def normal(text: str, spark, sf_dir) -> DataFrame:
    return imports.normalise(feeds.frame(spark, sf_dir, text))


_RIGHT_PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(14,4)) AS VARCHAR)"


@query(f"""
SELECT upper('cust-' || l_suppkey || '.com') AS CustomerDomainName, upper('p' || l_partkey) AS ProductId,
       CAST(l_linenumber AS VARCHAR) AS SkuId, CASE WHEN l_linenumber <= 6 THEN 'Usage' ELSE 'Seat fee' END AS ChargeType,
       CASE l_linenumber WHEN 1 THEN 'Annual' WHEN 2 THEN 'Annual' WHEN 3 THEN 'Monthly' WHEN 4 THEN 'Monthly'
            WHEN 5 THEN 'Triennial' WHEN 6 THEN 'NA' ELSE 'None' END AS Term,
       CASE l_linenumber WHEN 1 THEN CASE WHEN l_linestatus = 'F' THEN 'Annual' ELSE 'Monthly' END WHEN 2 THEN 'Annual'
            WHEN 3 THEN 'Monthly' WHEN 4 THEN 'Monthly' WHEN 5 THEN 'Monthly' WHEN 6 THEN 'NA' ELSE 'OneTime' END AS BillingCycle,
       upper('inv' || l_orderkey) AS InvoiceNumber, l_linenumber || ' name' AS ProductName,
       {_RIGHT_PRICE} AS UnitPrice, '-' || CAST(l_quantity AS INT) AS Quantity,
       CASE WHEN l_linenumber = 2 THEN 'n/a' ELSE '-' || {_RIGHT_PRICE} END AS Subtotal,
       CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ChargeStartDate,
       CASE WHEN l_linenumber = 3 THEN 'soon' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS ChargeEndDate,
       'Service' AS SubscriptionDescription, '' AS MpnId
FROM lineitem WHERE l_returnflag <> 'R' AND l_partkey % 89 <> 0""")
def canonical_map_right(spark, sf_dir):
    rows, _ = imports.canonical_right(normal(feeds.RAW_RIGHT, spark, sf_dir))
    return rows.select(
        "CustomerDomainName", "ProductId", "SkuId", "ChargeType", "Term", "BillingCycle", "InvoiceNumber",
        "ProductName", "UnitPrice", "Quantity", "Subtotal", "ChargeStartDate", "ChargeEndDate",
        "SubscriptionDescription", "MpnId")


@query(SQL["canonical_map_right"])
def csv_import(spark, sf_dir):
    path = as_csv(feeds.frame(spark, sf_dir, feeds.RAW_RIGHT))
    rows = imports.import_feed(spark, path, fixed.MICROSOFT).rows
    return rows.select(
        "CustomerDomainName", "ProductId", "SkuId", "ChargeType", "Term", "BillingCycle", "InvoiceNumber",
        "ProductName", "UnitPrice", "Quantity", "Subtotal", "ChargeStartDate", "ChargeEndDate",
        "SubscriptionDescription", "MpnId")


@query(f"""
SELECT upper('cust-' || l_suppkey || '.com') AS CustomerDomainName,
       upper(CASE WHEN l_partkey % 89 = 0 THEN 'pn-' || l_partkey ELSE 'p' || l_partkey END) AS ProductId,
       CASE WHEN l_partkey % 89 = 0 THEN 'PN-' || l_partkey ELSE 'SKU' || l_linenumber END AS SkuId,
       'Service' AS ProductName, {_RIGHT_PRICE} AS UnitPrice, {_RIGHT_PRICE} AS Total,
       CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ChargeStartDate, 'Annual' AS TermAndBillingCycle,
       'Monthly' AS BillingFrequency, 'REF' || l_orderkey AS ReferenceId, '' AS Currency
FROM lineitem WHERE l_returnflag <> 'A' AND (l_partkey % 89 <> 0 OR l_returnflag <> 'N')""")
def canonical_map_left(spark, sf_dir):
    rows, _ = imports.canonical_left(normal(feeds.RAW_LEFT, spark, sf_dir))
    return rows.select(
        "CustomerDomainName", "ProductId", "SkuId", "ProductName", "UnitPrice", "Total", "ChargeStartDate",
        "TermAndBillingCycle", "BillingFrequency", "ReferenceId", "Currency")


@query(SQL["canonical_map_left"])
def csv_auto_import(spark, sf_dir):
    """The kind comes from the name."""
    path = as_csv(feeds.frame(spark, sf_dir, feeds.RAW_LEFT), f"{staging.new_path(spark, 'import')}/IND_2024")
    return imports.import_feed(spark, path).rows.select(
        "CustomerDomainName", "ProductId", "SkuId", "ProductName", "UnitPrice", "Total", "ChargeStartDate",
        "TermAndBillingCycle", "BillingFrequency", "ReferenceId", "Currency")


def numbered_right(spark, sf_dir) -> imports.Feed:
    return imports.import_feed(spark, as_numbered_csv(spark, sf_dir, feeds.NUMBERED_RIGHT), fixed.MICROSOFT)


_NUMBERED = f"""WITH x AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY file_no ORDER BY l_orderkey, l_linenumber, CustomerDomainName, ProductId, ChargeType,
    InvoiceNumber, SkuId, ProductName, UnitPrice, Quantity, Subtotal, ChargeStartDate, ChargeEndDate, TermAndBillingCycle, BillingFrequency,
    SubscriptionDescription) AS BIGINT) AS n
  FROM ({feeds.sql(feeds.NUMBERED_RIGHT)}) f)"""


@query(f"""{_NUMBERED}, z AS (SELECT *, 'Customer: (missing), SKU: ' || SkuId AS c FROM x)
SELECT file_no, n AS "row", 'Error' AS level, 'Q7' AS rule, 'Subtotal' AS "column", 'Invalid numeric ''n/a'' – unable to parse.' AS description,
       'n/a' AS raw_value, '' AS context FROM z WHERE l_linenumber = 2
UNION ALL SELECT file_no, n, 'Error', 'Q7', 'ChargeEndDate', 'Invalid date ''soon'' – unable to parse.', 'soon', '' FROM z WHERE l_linenumber = 3
UNION ALL SELECT file_no, n, 'Error', 'Q4', 'ChargeEndDate', 'Invalid date format', 'soon', c FROM z WHERE l_linenumber = 3
UNION ALL SELECT file_no, n, 'Warning', 'Q5', 'Subtotal', 'Negative total value', '-' || rtrim(Subtotal, '-'), c FROM z WHERE l_linenumber <> 2""")
def csv_import_findings(spark, sf_dir):
    """Findings of an import with their file and row number."""
    found = numbered_right(spark, sf_dir).findings
    return found.select(file_no("file_name"), "row", "level", "rule", "column", "description", "raw_value", "context")


@query(f"""{_NUMBERED}
SELECT file_no, n AS "row", 'WARN' AS level, 'Row skipped: missing CustomerDomainName or ProductId' AS message FROM x WHERE trim(ProductId) = ''""")
def csv_import_rejects(spark, sf_dir):
    return numbered_right(spark, sf_dir).rejects.select(file_no(), F.col("_row").alias("row"), "level", "message")


def _plain_sql(expr: str) -> str:
    return f"rtrim(rtrim(CAST(CAST({expr} AS DECIMAL(28,6)) AS VARCHAR), '0'), '.')"


_PRODUCT = ("CASE WHEN l_linenumber IN (2, 3) THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(12,2)) "
            "* CAST(l_quantity AS DECIMAL(4,0)) END")


@query(f"""
SELECT upper('cust-' || l_suppkey || '.com') AS CustomerDomainName, 'Sku' || l_linenumber AS SkuName,
       CAST(l_orderkey AS VARCHAR) AS OrderId, {_plain_sql(_PRODUCT)} AS Subtotal,
       {_plain_sql(f'{_PRODUCT} + CAST(l_tax AS DECIMAL(4,2))')} AS Total, 'Monthly' AS TermAndBillingCycle
FROM lineitem WHERE l_partkey % 89 <> 0""")
def expression_columns(spark, sf_dir):
    # The cells are mapped as loaded: cleaning would strip the zeros of the tax column, a text class name.
    raw = feeds.frame(spark, sf_dir, feeds.RAW_DISTRIBUTOR)
    rows = sc.normalise_mapped(sc.map_canonical(raw.where(sc.has_key(raw, fixed.DISTRIBUTOR)), fixed.DISTRIBUTOR))
    return rows.select("CustomerDomainName", "SkuName", "OrderId", "Subtotal", "Total", "TermAndBillingCycle")


@query(f"""
SELECT CAST(l_orderkey AS VARCHAR) AS OrderId, {_plain_sql(_PRODUCT)} AS Subtotal,
       {_plain_sql(f'{_PRODUCT} + CAST(l_tax AS DECIMAL(4,2))')} AS Total FROM lineitem""")
def product_rules(spark, sf_dir):
    """Columns mapped as a product, and as a product plus a column."""
    rules = {"OrderId": "OrderNumber", "Subtotal": ("CustomerUnitPrice", "Quantity", "*"),
             "Total": ("CustomerUnitPrice", "Quantity", "+", "CustomerTax")}
    raw = feeds.frame(spark, sf_dir, feeds.RAW_DISTRIBUTOR)
    return sc.map_canonical(raw, "own", replace(OPTIONS, column_maps={"own": rules})).select("OrderId", "Subtotal", "Total")


@query("""
SELECT o_orderkey, o_orderstatus || '|' || o_orderkey || '|' || o_custkey || '|' || o_orderpriority AS shown FROM orders""")
def shown_columns(spark, sf_dir):
    """Hidden columns left out, leading ones in front, the rest as they were."""
    feed = feeds.table("orders")(spark, sf_dir).select(
        "o_orderkey", F.col("o_custkey").alias("CustomerId"), F.lit("x").alias("unittype"), F.col("o_orderstatus").alias("Status"),
        F.lit("EUR").alias("Currency"), F.col("o_orderpriority").alias("Priority"))
    rows = sc.reorder(sc.hide_columns(feed), ["status", "absent"])
    return rows.select("o_orderkey", F.concat_ws("|", *[tx.column(rows, c) for c in rows.columns]).alias("shown"))


@query(f"""
SELECT l_orderkey, l_linenumber, {d('CAST(l_quantity AS DECIMAL(18,6)) + CAST(l_extendedprice AS DECIMAL(18,6)) * 2')} AS sum_product,
       {d('CASE WHEN l_tax = 0 THEN 0 ELSE CAST(l_quantity * 100 AS BIGINT) / 100.0 END')} AS guarded
FROM lineitem""")
def arithmetic_rules(spark, sf_dir):
    items = feeds.table("lineitem")(spark, sf_dir)

    def value_of(name):
        return num.amount(items, name)
    return items.select(
        "l_orderkey", "l_linenumber",
        arithmetic("{l_quantity} + {l_extendedprice} * 2", value_of).alias("sum_product"),
        # Division by a zero tax fails, which makes the whole rule 0.
        arithmetic("{l_quantity} * ({l_tax} / {l_tax})", value_of).alias("guarded"))


@query("""
SELECT c_custkey, upper(CASE WHEN c_nationkey % 3 = 0 THEN c_name ELSE c_mktsegment END) AS CustomerDomainName,
       'C' || c_custkey AS ProductId, CASE WHEN c_nationkey % 2 = 0 THEN '5' ELSE '7' END AS Quantity,
       '' AS ChargeType, '1.5' AS MSRPPrice, '' AS SubscriptionId, '2024-02-01' AS ChargeStartDate
FROM customer""")
def alias_merge(spark, sf_dir):
    customer = feeds.table("customer")(spark, sf_dir)
    feed = customer.select(
        "c_custkey",
        F.when(F.col("c_nationkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("CustomerDomainName"),
        F.lit("").alias("CustomerName"), F.col("c_name").alias("CustomerId"), F.lit("unused").alias("DomainUrl"),
        F.concat(F.lit(" c"), F.col("c_custkey").cast("string")).alias("PartNumber"),
        F.when(F.col("c_nationkey") % 2 == 0, "5").otherwise("").alias("Quantity"),
        F.lit("7").alias("BillableQuantity"), F.lit("1.5").alias("MSRP"), F.lit("2/1/2024").alias("ChargeStartDate"),
    )
    return sc.prepare_side(feed).select(
        "c_custkey", "CustomerDomainName", "ProductId", "Quantity", "ChargeType", "MSRPPrice", "SubscriptionId",
        "ChargeStartDate")


@query(f"""
SELECT TermAndBillingCycle, BillingFrequency,
       CASE TermAndBillingCycle WHEN 'One-Year commitment for monthly/yearly billing' THEN 'Annual'
         WHEN 'One-Year commitment for yearly billing' THEN 'Annual'
         WHEN 'One-Month commitment for monthly billing' THEN 'Monthly' WHEN '1 Cache Instance Hour' THEN 'Monthly'
         WHEN 'Three-3 Years commitment for monthly/3 Years/yearly billing' THEN 'Triennial' WHEN '' THEN 'None' ELSE 'NA' END AS Term,
       CASE TermAndBillingCycle WHEN 'One-Year commitment for monthly/yearly billing'
         THEN CASE WHEN BillingFrequency = '' THEN 'Annual' ELSE 'Monthly' END
         WHEN 'One-Year commitment for yearly billing' THEN 'Annual'
         WHEN 'One-Month commitment for monthly billing' THEN 'Monthly' WHEN '1 Cache Instance Hour' THEN 'Monthly'
         WHEN 'Three-3 Years commitment for monthly/3 Years/yearly billing' THEN 'Monthly' WHEN '' THEN 'OneTime' ELSE 'NA' END
         AS BillingCycle, CAST(count(*) AS BIGINT) AS n
FROM ({feeds.sql(feeds.RAW_RIGHT)}) x GROUP BY 1, 2""")
def term_cycle(spark, sf_dir):
    split = sc.split_term(feeds.frame(spark, sf_dir, feeds.RAW_RIGHT))
    return split.groupBy("TermAndBillingCycle", "BillingFrequency", "Term", "BillingCycle").agg(
        F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'WARN' AS level, 'Row skipped: missing CustomerDomainName or ProductId' AS message, CAST(count(*) AS BIGINT) AS n
FROM lineitem WHERE l_partkey % 89 = 0 AND l_returnflag = 'N'""")
def key_reject(spark, sf_dir):
    _, rejects = imports.canonical_left(normal(feeds.RAW_LEFT, spark, sf_dir))
    return rejects.groupBy("level", "message").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'Error' AS level, "column", description, raw_value, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'Subtotal' AS "column", 'Invalid numeric ''n/a'' – unable to parse.' AS description, 'n/a' AS raw_value
  FROM lineitem WHERE l_linenumber = 2
  UNION ALL
  SELECT 'ChargeEndDate', 'Invalid date ''soon'' – unable to parse.', 'soon' FROM lineitem WHERE l_linenumber = 3) x
GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4"))
def import_findings(spark, sf_dir):
    found = imports.normalise_findings(feeds.frame(spark, sf_dir, feeds.RAW_RIGHT))
    return found.groupBy("level", "column", "description", "raw_value").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'right' AS feed, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_returnflag <> 'R' AND l_partkey % 89 <> 0
UNION ALL
SELECT 'left', CAST(count(*) AS BIGINT) FROM lineitem
WHERE l_returnflag <> 'A' AND (l_partkey % 89 <> 0 OR l_returnflag <> 'N')""")
def feed_row_counts(spark, sf_dir):
    right, _ = imports.canonical_right(normal(feeds.RAW_RIGHT, spark, sf_dir))
    left, _ = imports.canonical_left(normal(feeds.RAW_LEFT, spark, sf_dir))
    counted = imports.row_count(right).withColumn("feed", F.lit("right")).unionByName(
        imports.row_count(left).withColumn("feed", F.lit("left")))
    return counted.select("feed", "n")


@query(f"""
SELECT 'exact' AS spelling, CAST(count(*) AS BIGINT) AS kept FROM ({feeds.sql(feeds.LEFT)}) x WHERE ProductName <> 'Azure plan'
UNION ALL
SELECT 'any case', CAST(count(*) AS BIGINT) FROM ({feeds.sql(feeds.LEFT)}) x WHERE lower(ProductName) <> 'azure plan'""")
def usage_plan_filter(spark, sf_dir):
    feed = feeds.frame(spark, sf_dir, feeds.LEFT)

    def kept(spelling: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(spelling).alias("spelling"), "kept")
    return kept("exact", filters.drop_usage_plan(feed, "ProductName")).unionByName(
        kept("any case", filters.drop_usage_plan_any_case(feed, "ProductName")))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Microsoft' WHEN 1 THEN 'Partner' WHEN 2 THEN 'Distributor' END AS source_type
FROM orders""")
def source_detection(spark, sf_dir):
    orders = feeds.table("orders")(spark, sf_dir)
    prefix = (F.when(F.col("o_orderkey") % 4 == 0, "g0").when(F.col("o_orderkey") % 4 == 1, "Ind")
              .when(F.col("o_orderkey") % 4 == 2, "billingTransactions_").otherwise("x"))
    name = F.concat(prefix, F.col("o_orderkey").cast("string"), F.lit(".csv"))
    return orders.select("o_orderkey", sources.source_kind(name).alias("source_type"))


LEGACY_COLUMNS = ("InvoiceNumber", "ChargeType", "ChargeStartDate", "UnitPrice", "MSRPPrice", "PartnerDiscountPercentage")
LEGACY_SQL = f"""
SELECT upper('inv' || l_orderkey) AS InvoiceNumber, CASE WHEN l_linenumber <= 6 THEN 'USAGE' ELSE 'SEAT  FEE' END AS ChargeType,
       strftime(l_shipdate, '%m/%d/%Y') AS ChargeStartDate, {_RIGHT_PRICE} AS UnitPrice, '' AS MSRPPrice,
       '' AS PartnerDiscountPercentage
FROM lineitem"""


def legacy_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = feeds.frame(spark, sf_dir, feeds.RAW_LEFT).withColumnsRenamed({
        "PartnerInvoiceNumber": "InvoiceNumber", "ValidFrom": " ChargeStartDate"})
    return raw.withColumn("UnitPrice", F.lit("replaced"))


@query(LEGACY_SQL)
def legacy_feed(spark, sf_dir):
    return sc.legacy_feed(legacy_raw(spark, sf_dir)).select(*LEGACY_COLUMNS)


@query(LEGACY_SQL)
def legacy_file(spark, sf_dir):
    return imports.import_legacy(spark, as_csv(legacy_raw(spark, sf_dir))).select(*LEGACY_COLUMNS)

"""URL filters: rules found by equi-join on short hash prefixes of a URL's expressions.

A rule is a host and a path prefix. For every shape that occurs among the rules
(number of host labels, length of path), a URL has one expression: its last so many
labels and its path's first so many characters. The first 32 bits of an expression's
SHA-256 digest are joined with those of the rules; the full digest confirms a match.
The longest rule wins, a longer host before a longer path.

A URL is expanded once, however many pages repeat it.

Defined cases: a null URL, or one without ``://``, has empty host and path, fits no
rule and gets the default verdict; so does any other URL that no rule fits. A path is
compared as it is written. Equal rules with different verdicts: block wins.
Pages keep further columns, but for those that have the name of an added one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm.scratch import without

Rule = tuple[str, str, str]

#: (verdict, host, path)
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """One row per distinct rule: rule, verdict, prefix, digest, and its lengths."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows))).groupBy("h", "p").agg(F.max("verdict").alias("verdict")).select(
        F.concat("h", "p").alias("rule"), "verdict", F.length("h").alias("host_length"), F.length("p").alias("path_length"),
        F.sha2(F.concat("h", "p"), 256).alias("digest"),
    ).withColumn("prefix", F.substring("digest", 1, 8))


def expressions(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The URL's expressions of the shapes that the rules have; their number is bounded by the rules."""
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    labels = F.split(host, r"\.", -1)
    made = [
        F.when(
            (F.size(labels) >= n) & (F.length(path) >= k),
            F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, k)),
        ) for n, k in shapes
    ]
    return F.array_distinct(F.array_compact(F.array(*made)))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict."""
    pages = without(pages, "host", "path", "rule", "verdict", "_url", "_best")
    if not rules:
        return pages.withColumns({
            "host": host_of(F.col("url")), "path": path_of(F.col("url")),
            "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    urls = pages.filter(F.contains("url", F.lit("://"))).select(F.col("url").alias("_url")).distinct()
    expanded = urls.select("_url", F.explode(expressions(host_of(F.col("_url")), path_of(F.col("_url")), rules)).alias("expression"))
    hashed = expanded.select("_url", F.sha2("expression", 256).alias("found")).withColumn("prefix", F.substring("found", 1, 8))
    fitting = hashed.join(rule_table(pages.sparkSession, rules), "prefix").filter("found = digest")
    best = fitting.groupBy("_url").agg(F.max(F.struct(
        (F.col("host_length") + F.col("path_length")).alias("length"), "host_length", "rule", "verdict")).alias("_best"))
    return pages.join(best, F.col("url") == F.col("_url"), "left").select(
        *pages.columns, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))

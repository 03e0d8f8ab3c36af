"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.scratch import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per node of ``links``: node and component, the least node that it reaches.

    Rounds of large-star and small-star: every node sends its neighbours to its least
    neighbour. Least neighbours are found with map-side combining, so a node with very many
    links is no hot group. Every round is written to the shared folder. Links to oneself
    are allowed and give a component of one; nulls are left out.
    """
    both_known = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = both_known.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = written(pairs.distinct(), "links")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").distinct()
        pairs = written(small, "links")
        state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before:
            break
        before = state
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


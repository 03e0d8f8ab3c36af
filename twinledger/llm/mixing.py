"""Mixing sources to target weights by capped water-filling.

Sources share the size of the corpus by their weights. A source whose share is
more than ``max_epochs`` times its own size is clamped there, and the excess goes
to the others by weight, until none is above its clamp. With sources in ascending
order of clamp / weight, the clamped ones are the first ones, so the water level is
found with running sums over one row per source.

A source's documents are then taken ``whole`` times, and once more in a seeded
order (MD5 of seed and doc_id) until the target is met; the last of these is taken
in part, so a source's words meet its target to the word. The order is cut into
4,096 ranges of the hash: a running sum over the ranges' sizes finds the range where
the target is met, and only that range's documents are sorted. No source is sorted
or gathered as a whole, however large.

Defined cases: null or empty text has size 0; the null source is a source and comes
last; sources without words have target 0; equal documents are told apart by nothing
and share what is left in any order; repeated rows each count; an empty table gives
no rows. Further columns stay, but for those that
have the name of an added one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinledger.llm.scratch import without, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """Per source its weight and target, from ``source`` and ``source_size``: one row per source.

    The windows without keys run over these rows only.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    sized = sizes.withColumn("weight", weight).withColumn("clamp", F.col("source_size") * max_epochs)
    by_clamp = Window.orderBy(F.col("clamp") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_clamp.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_clamp.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = sized.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("clamp").over(before), F.lit(0)))
        / F.sum("weight").over(onward),
    )
    reached = F.when(F.col("level") * F.col("weight") <= F.col("clamp"), F.col("level"))
    # Levels rise up to the first that is reached and fall from there, so the greatest reached is it.
    return levels.withColumn("water", F.max(reached).over(everything)).withColumn(
        "target", F.least(F.col("clamp").cast("double"), F.coalesce("water", F.lit(float("inf"))) * F.col("weight"))
    ).select("source", "source_size", "weight", "target")


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 17,
) -> DataFrame:
    """``docs`` with size, source_size, target, whole (times taken as a whole), extra (further words) and taken."""
    docs = without(docs, "size", "source_size", "target", "whole", "extra", "taken", "_key", "_range", "_source", "_at", "_room")
    sized = docs.withColumns({
        "size": word_count(F.col("text")),
        "_key": seeded_key(F.col("doc_id"), seed),
    }).withColumn("_range", F.substring("_key", 1, 3))
    ranges = written(
        sized.groupBy("source", "_range").agg(F.sum("size").alias("range_size")), "mix-ranges")
    aims = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    aims = aims.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)),
    ).withColumn("left", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    order = Window.partitionBy("source").orderBy("_range")
    placed = ranges.withColumn("upto", F.sum("range_size").over(order))
    named = placed.select(F.col("source").alias("s"), "_range", "range_size", "upto")
    crossing = aims.join(named, F.col("source").eqNullSafe(F.col("s")) & (F.col("upto") > F.col("left")), "left")
    plan = crossing.groupBy("source").agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "whole", "left")],
        F.min(F.struct("upto", "_range", "range_size")).alias("cross"),
    ).select(
        F.col("source").alias("_source"), "source_size", "target", "whole",
        F.coalesce("cross._range", F.lit("~")).alias("_at"),
        (F.col("left") - F.col("cross.upto") + F.col("cross.range_size")).alias("_room"),
    )
    plan = written(plan, "mix-plan")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    inside = F.col("_range") == F.col("_at")
    ahead = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum("size").over(ahead), F.lit(0))
    split = joined.filter(inside).withColumn(
        "extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_room") - run)))
    plain = joined.filter(~inside).withColumn(
        "extra", F.when(F.col("_range") < F.col("_at"), F.col("size")).otherwise(F.lit(0).cast("long")))
    return plain.unionByName(split).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra")).select(
        *docs.columns, "size", "source_size", "target", "whole", "extra", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once per repetition, the partly taken one cut after its last word."""
    own = [c for c in docs.columns if c in ("doc_id", "text", "source")]
    rest = [c for c in docs.columns if c not in own]
    carried = docs.select(*own, F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in rest]).alias("_rest"))
    taken = mix(carried, **options)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    cut = F.when(F.col("extra") >= F.col("size"), F.col("text")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("extra").cast("int")), " "))
    copies = F.concat(
        F.array_repeat(F.col("text"), F.col("whole").cast("int")),
        F.when(F.col("extra") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")),
    )
    names = {"text": F.col("_copy")} | {c: F.col("_rest").getField(c) for c in rest}
    return taken.filter("taken > 0").withColumn("_copy", F.explode(copies)).select(
        *[names.get(c, F.col(c)).alias(c) for c in docs.columns])

"""Row numbers without sorting everything into one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import written

#: Where a row was read: file path, block start, and a number that grows by one within the block.
PLACE = "_place"


def block_offsets(rows: DataFrame, place: str = PLACE) -> DataFrame:
    """Per file block of ``rows``: its first place, and how many rows the file has in earlier blocks.

    ``rows`` are all rows of a scan with their places, whose numbers follow each other within a block.
    """
    blocks = rows.groupBy(F.col(f"{place}.path").alias("_path"), F.col(f"{place}.block").alias("_block")).agg(
        F.min(f"{place}.nth").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    # The last grouping changes nothing; it tells the optimiser that a block has one row.
    return before.groupBy("_path", "_block").agg(F.first("_first").alias("_first"), F.first("_before").alias("_before"))


def with_row_numbers(df: DataFrame, offsets: DataFrame, row: str = "_row", place: str = PLACE) -> DataFrame:
    """Replaces a row's place by its 1-based number in its file.

    Only rows that show the number meet the offsets: where no later step reads it, the optimiser
    drops this outer join, as it can neither add nor remove rows. The offsets go to the rows, being one
    row per block: by Spark's estimate of their size all rows of a large table would be shuffled and sorted for them.
    """
    at = F.col(place)
    number = F.col("_before") + at["nth"] - F.col("_first") + 1
    joined = df.join(F.broadcast(offsets), (at["path"] == F.col("_path")) & (at["block"] == F.col("_block")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != place], number.alias(row))


def bucketed_ordinals(
    df: DataFrame, order: Sequence[str], bucket: Column | None = None, row: str = "_row"
) -> DataFrame:
    """1-based position by ``order``, NULL first.

    Without ``bucket`` the rows are dealt into ranges of all order columns, sorted there and written
    to the shared folder once; a row's number is its place in its range plus the rows of the ranges
    before. Equal first columns are told apart by the others, so no value is a hot range; the number
    of ranges is Spark's shuffle partitions.

    A given bucket must never decrease along the order (a day, a key divided by a width); NULL is a
    bucket of its own and comes first. Rows are ranked inside their bucket and shifted by the counts
    of the buckets before it; only the one row per bucket is ordered as a whole.
    """
    if bucket is None:
        return with_row_numbers(*_ranges(df, order), row)
    tagged = df.withColumn("_bucket", bucket)
    sizes = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return (
        tagged.withColumn("_place", inside)
        .join(offsets, F.col("_bucket").eqNullSafe(F.col("_of")))
        .withColumn(row, F.col("_before") + F.col("_place"))
        .drop("_bucket", "_place", "_before", "_of")
    )


def _ranges(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows by ranges of the order, each with its range as block and its place in it, and the ranges' offsets.

    Written, since the borders come from a sample: rows and offsets must see the same ones.
    """
    columns = [F.col(f"`{c}`") for c in order]
    dealt = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    place = F.struct(F.lit("").alias("path"), F.spark_partition_id().cast("long").alias("block"), F.monotonically_increasing_id().alias("nth"))
    rows = written(dealt.select("*", place.alias(PLACE)), "ranges")
    return rows, block_offsets(rows)


def running_number(df: DataFrame, order: Sequence[str], name: str = "Row Number") -> DataFrame:
    """Numbers rows 1..n along ascending columns that order them totally, NULL first, for result tables shown as a list."""
    numbered = bucketed_ordinals(df, order, row=name)
    return numbered.select(F.col(f"`{name}`"), *[F.col(f"`{c}`") for c in df.columns])

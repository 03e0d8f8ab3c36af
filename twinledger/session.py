"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings; safe to call on any session.

    Dates are read in UTC. Wide feeds compile to very large stage methods, which
    the JVM leaves uncompiled beyond 8000 bytes; the limit makes Spark split them.
    A table's row takes some 20 bytes in Parquet and several hundred in a grouping by
    key, so a task reads 8 MB: the groups it combines stay in memory.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    return spark

"""Tables written to the shared folder, to cut lineage and to be read more than once."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, if they can see that folder.

    Elsewhere the package has to be installed on the workers or given with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
    return spark


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="twinledger-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, what: str) -> str:
    return f"{folder(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a finished query or write go at once: what was written is read instead."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df``, read back from a new Parquet table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, what)
    with shuffles_dropped(spark):
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more, wherever Spark keeps it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names in any case, which an operator is about to add."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])

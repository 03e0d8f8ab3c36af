"""From the documents table to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the
columns of documents. ``run`` writes each stage's rows as Parquet and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinledger.llm import jaccard_join, langid, mixing, packing, substring_dedup
from twinledger.llm.scratch import reachable, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts near a known language, which becomes their lang; rejected ones go."""
    found = langid.identify(docs, langid.train(docs))
    return found.filter(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least doc_id; rows without doc_id stay.

    Unlike texts under one doc_id are documents of their own, the least in front. Rows that share
    doc_id and text are one document, with the least of their other columns.
    """
    rest = [n for n in docs.columns if n not in ("doc_id", "text")]
    known = docs.filter("doc_id IS NOT NULL").repartition("doc_id").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    known = known.withColumn("_nth", nth).withColumn("_id", F.when(F.col("_nth") == 1, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text")))
    known = written(known.select("_id", "_nth", "doc_id", "text", "_rest.*"), "pipeline-texts")
    groups = jaccard_join.similar_documents(known.select(F.col("_id").alias("doc_id"), "text"))
    named = groups.select(F.col("doc_id").alias("_id"), "component_id").join(known.select("_id", "_nth", "doc_id"), "_id")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "_nth", "_id")).alias("first")).select("first._id")
    kept = known.join(first, "_id", "left_semi").select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word sequences that occur earlier; untouched ones as they were."""
    cleaned = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cleaned.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mix", mixture),
    ("packing", sequences),
]

#: Tokenised and trained stages are not SQL; tests/llm compares the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs

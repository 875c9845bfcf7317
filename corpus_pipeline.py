"""The corpus pipeline: five of the training-data operators in a row, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm import language, mixing, neardup, packing, substrings
from redactory.llm.session import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nearest centroids: documents that are rejected (no letters, or far from every language) go; a kept one keeps its lang."""
    return language.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ProbMinHash: one document of each class stays, that of the smallest id."""
    return neardup.kept(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix trees by prefix: passages of 13 words or more that a document with a smaller id has are cut; n_chars follows the text."""
    cut = substrings.deduplicated(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else cut


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weighted fair queueing: each document as often as the mix takes it, in order of virtual finish time."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best fit over several lengths: where each piece of each document lies."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing_to_targets),
    ("packing", best_fit_packing),
]
#: Trained centroids, signatures and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table goes when the next one is written; the last stays, since the result is read from it."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs

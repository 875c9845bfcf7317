"""The registered queries of the training-data operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language, mixing, neardup, packing, preference, rules, substrings, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts Python looks through. One that comes in fewer pieces than there are cores (a small file of one row group) is dealt out; larger ones are read as they lie."""
    df, pieces = table(spark, sf_dir, name), min(spark.sparkContext.defaultParallelism, 64)
    return df if df.rdd.getNumPartitions() >= pieces else df.repartition(pieces)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(dealt(spark, sf_dir, "documents")).drop("passages")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.fitted(dealt(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.fitted(dealt(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(dealt(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.examples(turns.unionByName(chat.probe(spark))))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(dealt(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_topk": op7_topk,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_near_duplicates": op10_near_duplicates,
}
ORACLES: dict[str, str] = {"op2_substring_dedup": substrings.SQL, "op6_chat_formatting": chat.SQL, "op7_topk": topk.SQL, "op8_warc": warc.SQL, "op9_mixing": mixing.SQL}

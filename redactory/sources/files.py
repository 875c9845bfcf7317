"""Texts, maps and allowlists in and out of files, through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.plans.errors import RedactionError


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: path and text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_texts(df: DataFrame, path: str, force: bool = False, column: str = "text") -> None:
    """Writes a text column; an output that is there already is only replaced by force."""
    df.select(F.col(column).alias("value")).write.mode("overwrite" if force else "errorifexists").text(path)


def write_map(df: DataFrame, path: str, key: str, force: bool = False, column: str = "map") -> None:
    """A restoration map as JSON rows of key, placeholder and original."""
    df.select(key, F.explode(column).alias("placeholder", "original")).write.mode("overwrite" if force else "errorifexists").json(path)


def read_map(spark: SparkSession, path: str, key: str, key_type: str = "long") -> DataFrame:
    rows = spark.read.schema(f"{key} {key_type}, placeholder string, original string").json(path)
    return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("map"))


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Values of an allowlist file, one a line, trimmed, blank lines dropped: a frame for native.without_allowed."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def allowlist_values(spark: SparkSession, path: str, most: int = 100_000) -> tuple[str, ...]:
    """An allowlist file for a policy, which every task holds: bounded; longer lists go by anti-join."""
    rows = read_allowlist(spark, path).limit(most + 1).collect()
    if len(rows) > most:
        raise RedactionError("INVALID_CONFIG", "allowlist")
    return tuple(r["value"] for r in rows)


def text_stream(spark: SparkSession, path: str, schema: str = "stream_id string, seq long, chunk string, is_last boolean") -> DataFrame:
    """Chunks that arrive as JSON files."""
    return spark.readStream.schema(schema).json(path)


def read_names(spark: SparkSession, path: str, most: int = 500_000) -> frozenset[str]:
    """A list of names for a policy, one a line, in small letters: the first word of each line, so census tables with figures behind the name do as they are. Bounded, since every task holds it."""
    word = F.lower(F.regexp_extract(F.col("value"), r"^\s*([\p{L}'’-]+)", 1))
    rows = spark.read.text(path).select(word.alias("name")).where("name <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise RedactionError("INVALID_CONFIG", "names")
    return frozenset(r["name"] for r in rows)

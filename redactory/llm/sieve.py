"""A bitmap of hashed keys that lets most rows without a partner pass by a join, and per-key figures without a hot task.

Both are made of DataFrame operations alone. A bitmap's size grows with its keys up to ``MOST`` bits (16 MiB broadcast);
beyond that more rows take the join that follows, which alone decides, so results don't hang on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST, PER_KEY = 1 << 15, 1 << 27, 16
SALTS = 64


def _position(columns: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns, F.lit(11)), F.lit(bits)) + 1


def sifted(rows: DataFrame, columns: list[str], keys: DataFrame, of: list[str], n: int) -> DataFrame:
    """rows with a boolean column ``__hit``: false where no row of keys (n of them) has the same values, nulls as values, in its columns ``of``."""
    bits = min(MOST, max(LEAST, 1 << (PER_KEY * max(1, n) - 1).bit_length()))
    at = _position(of, bits)
    maps = keys.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
    placed = rows.withColumn("__at", _position(columns, bits)).withColumn("__slot", F.bitmap_bucket_number("__at")).withColumn("__bit", F.bitmap_bit_position("__at"))
    byte = F.conv(F.hex(F.substr("__bits", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = placed.join(F.broadcast(maps), F.col("__slot") == F.col("__bucket"), "left").withColumn("__byte", byte)
    hit = F.coalesce(F.expr("shiftright(__byte, cast(__bit % 8 as int)) & 1 = 1"), F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias("__hit"))


def with_figure(rows: DataFrame, key: str, by: str, partial: Column, whole: Column, name: str) -> DataFrame:
    """rows with a figure of all rows of their key. Rows meet it by key and salt (hash of ``by``), so no key is one task's.

    ``partial`` aggregates rows to a column ``__p`` by key and salt, ``whole`` aggregates ``__p`` by key.
    """
    salted = rows.withColumn("__s", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    parts = salted.groupBy(key, "__s").agg(partial.alias("__p"))
    told = parts.join(parts.groupBy(key).agg(whole.alias(name)).hint("merge"), key).select(key, "__s", name)
    return salted.join(told.hint("merge"), [key, "__s"]).drop("__s")


def with_lookup(rows: DataFrame, key: str, by: str, table: DataFrame, of: str) -> DataFrame:
    """rows with the columns of table, in which each value of ``of`` stands once at most (left join), met by key and salt as well."""
    salted = rows.withColumn("__s", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    told = salted.select(key, "__s").distinct().join(table.withColumnRenamed(of, "__of").hint("merge"), F.col(key) == F.col("__of"), "left").drop("__of")
    return salted.join(told.hint("merge"), [key, "__s"]).drop("__s")

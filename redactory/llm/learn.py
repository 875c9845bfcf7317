"""What the two trained operators share: bounded labelled samples and n-gram counts of whole texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SALTS = 32


def remainder(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _smallest(rows: DataFrame, label: str, columns: list[str], hashed: list[str], per_label: int) -> DataFrame:
    """Of each label about per_label rows, those of the smallest hashes. Each label is split by hash in SALTS parts that are ranked apart, so a label that most rows have is no hot group."""
    order = W.partitionBy(label, "__salt").orderBy("__h", *hashed)
    ranked = rows.withColumn("__h", F.xxhash64(*hashed, F.lit(7))).withColumn("__salt", F.pmod("__h", F.lit(SALTS)))
    return ranked.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= -(-per_label // SALTS)).select(*columns)


def sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """About per_label ids of each label (doc_id, label), those of the smallest hashes: a bounded sample of all rows, each id and label once."""
    return _smallest(rows.select("doc_id", label).distinct(), label, ["doc_id", label], ["doc_id"], per_label)


def sampled_rows(docs: DataFrame, chosen: DataFrame, on: list[str], label: str, per_label: int) -> DataFrame:
    """text and label of the rows of docs that a sample (at most about per_label ids a label, broadcast) names, again at most about per_label a label: an id may stand on any number of rows."""
    rows = docs.join(F.broadcast(chosen), on).select("text", label)
    return _smallest(rows, label, ["text", label], ["text"], per_label)


def histogram(rows: DataFrame, by: list[str], value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Rows (by, bin, n) of a value in equal bins from low to high."""
    bin = F.least(F.greatest(F.floor((value - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*by, bin.alias("bin")).agg(F.count("*").alias("n"))


#: ASCII letters in lower case, white space as a space, bytes of other characters as they are; 0 drops digits and symbols.
_FOLD = np.zeros(256, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[[9, 10, 11, 12, 13, 32]] = 32


def letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buffer without digits and symbols, runs of white space as one space and one before each row, Latin letters folded; and the rows' new offsets."""
    b = _FOLD[raw]
    latin = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    b[latin] += 32
    keep = b > 0
    at = np.zeros(len(b) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    b, offsets = b[keep], at[offsets]
    again = np.ones(len(b), bool)
    again[1:] = (b[1:] != 32) | (b[:-1] != 32)
    at = np.zeros(len(b) + 1, np.int64)
    np.cumsum(again, out=at[1:])
    offsets = at[offsets]
    return np.insert(b[again], offsets[:-1], 32), offsets + np.arange(len(offsets))


def trigrams(b: np.ndarray, bits: int) -> np.ndarray:
    """A code for the three bytes at each position but the last two."""
    b = b.astype(np.uint32)
    code = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(32 - bits)).astype(np.int32)

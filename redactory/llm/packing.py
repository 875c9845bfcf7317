"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces (whole documents; those longer than the largest length are cut into pieces of it) are packed longest first. A
piece goes to the open bin of any length that it fills best. If none has room, that length is opened whose cost a word
is least, given what the pieces still to come can fill of it: lengths compete jointly, long bins where much small matter
follows, exact ones otherwise. At the end each bin is downsized to the smallest permitted length that holds its
contents. The cost of a length is its words, and ``overhead`` for each sequence.

Documents are dealt to shards of about ``shard_words`` words by a hash of their id, and each shard is packed by itself,
so tasks are bounded and even whatever the sources; only lengths are shuffled, never texts.

Defined results: documents without words (null or empty) are in no bin; repeated rows are packed each; ties go to the
bin opened first; a null doc_id is packed like any other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
SHARD_WORDS = 4_000_000
WORD = r"[^\x20\x09-\x0D]+"


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in it and offset of each piece (sizes up to the largest length, over 0), and each bin's final length."""
    lengths = tuple(sorted(lengths))
    order = np.argsort(-sizes, kind="stable")
    # What the pieces from here on weigh that are of at most a given size: pieces come longest first, so those are tails.
    ordered = sizes[order]
    tail = np.append(np.cumsum(ordered[::-1])[::-1], 0)
    bin_of, place, offset = (np.zeros(len(sizes), np.int64) for _ in range(3))
    used, pieces = [], []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    opened: list[int] = []
    for k, piece in enumerate(order):
        size = int(sizes[piece])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            best = None
            for length in lengths:
                if length >= size:
                    spare = length - size
                    fitting = max(k + 1, int(np.searchsorted(-ordered, -spare, "left")))
                    filled = size + min(spare, int(tail[fitting]))
                    cost = (length + overhead) / filled
                    if best is None or cost < best[0]:
                        best = (cost, length)
            b, free = len(used), best[1]
            used.append(0)
            pieces.append(0)
            opened.append(best[1])
        bin_of[piece], place[piece], offset[piece] = b, pieces[b], used[b]
        used[b] += size
        pieces[b] += 1
        if free > size:
            insort(room, (free - size, b))
    capacity = np.array(lengths)[np.searchsorted(lengths, used)] if used else np.zeros(0, np.int64)
    return bin_of, place, offset, capacity


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per piece: its document and words, its shard and bin, place and offset in the bin, and the bin's length."""
    largest = max(lengths)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")).where("words > 0")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // (6 * shard_words)))
    last = ((F.col("words") - 1) / largest).cast("int")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("piece").cast("long") * largest
    pieces = pieces.select("doc_id", "piece", first.alias("first_word"), F.least(F.lit(largest).cast("long"), F.col("words") - first).alias("n_words"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        b, at, offset, capacity = pack(table.column("n_words").to_numpy(), lengths, overhead)
        for name, x in (("bin", b), ("place", at), ("offset", offset), ("capacity", capacity[b])):
            table = table.append_column(name, pa.array(x, pa.int32()))
        return table

    return pieces.groupBy("shard").applyInArrow(place, "doc_id long, piece int, first_word long, n_words long, shard int, bin int, place int, offset int, capacity int")


def sequences(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (shard, bin, capacity, words): the words of the pieces of each bin, in place. doc_id must be unique in docs."""
    words = docs.select("doc_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"))
    cut = placed.join(words, "doc_id").select("shard", "bin", "capacity", "place", F.slice("w", (F.col("first_word") + 1).cast("int"), F.col("n_words").cast("int")).alias("w"))
    return cut.groupBy("shard", "bin", "capacity").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda x: x["w"])).alias("words"))

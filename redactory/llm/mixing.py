"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source is shuffled by a hash of its id and queued up to ``most`` times (epochs). Its virtual finish
time is the source's words queued up to and including it, divided by the source's target. The queue of all sources is
range-sorted by finish time and cut where the words taken reach the budget, the words of all documents.

Prefix sums never gather a source in one task: each source is split in hash buckets by its number of rows, buckets are
summed first, and rows are ordered inside their bucket alone. The cut is found the same way, from sums by slice of
finish time; one slice is then ordered.

Defined results: a null text has size 0; size-0 documents are never taken (0 words) and do not move the queue; a null
source is a source of its own, last in order; rows of equal id, source and size are peers, taken together or not at
all; null ids hash by size; an empty table gives no rows; other columns are carried along unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .session import Scratch, written

WEIGHTS, MOST = (5, 2, 1), 3
#: Rows of a source in a hash bucket, at most about; rows in a slice of finish times, about.
ROWS_IN_BUCKET, ROWS_IN_SLICE = 1_000, 20_000
#: Tables of group sums are broadcast up to so many rows (under 16 MB); larger ones are joined by shuffle, and hash buckets keep that even.
BROADCAST_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def _sized(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    shuffled = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("size "), F.col("size").cast("string")))), 1, 15), 16, 10).cast("long")
    return sized.withColumn("h", shuffled)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with weight and target: words in proportion to weights, none above ``most`` times its source's size, the excess shared anew by weight.

    In order of capacity / weight the full sources come first, so one pass of running sums finds them all.
    """
    order = W.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("r", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("r") % len(weights) + 1).cast("int")).cast("long")
    by_fill = W.orderBy(F.col("cap") / F.col("weight"), "r")
    all_rows = W.partitionBy()  # one row a source
    full = F.col("full")
    return (
        ranked.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("before", F.sum("cap").over(by_fill) - F.col("cap"))
        .withColumn("rest", F.sum("weight").over(all_rows) - F.sum("weight").over(by_fill) + F.col("weight"))
        .withColumn("full", ((F.col("total") - F.col("before")) * F.col("weight") >= F.col("cap") * F.col("rest")))
        .withColumn("left", F.col("total") - F.sum(F.when(full, F.col("cap")).otherwise(0)).over(all_rows))
        .withColumn("sharing", F.sum(F.when(full, 0).otherwise(F.col("weight"))).over(all_rows))
        .withColumn("target", F.when(full, F.col("cap").cast("double")).otherwise(F.col("left").cast("double") * F.col("weight") / F.col("sharing")))
        .select(*sizes.columns, "r", "weight", "target", "total")
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _finish(epoch: int | Column) -> Column:
    return (F.col("source_size") * epoch + F.col("queued")) / F.col("target")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, queued (its source's words up to it), epochs (times taken), taken (words)."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.write(_sized(docs), "sizes")
    count = rows.count()
    slices = max(16, 2 * count // ROWS_IN_SLICE)

    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / ROWS_IN_BUCKET))).cast("int")
    sources = scratch.write(targets(sources, weights, most).withColumnRenamed("source", "s").withColumn("bits", bits), "sources")
    known = rows.join(_small(sources, sources.count()), F.col("source").eqNullSafe(F.col("s"))).withColumn("b", F.expr("shiftright(h, 60 - bits)"))

    groups = known.groupBy("r", "b").agg(F.sum("size").alias("group_size"))
    running = W.partitionBy("r").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select(F.col("r").alias("r2"), F.col("b").alias("b2"), F.coalesce(F.sum("group_size").over(running), F.lit(0)).alias("ahead"))
    groups = scratch.write(groups, "groups")

    inside = W.partitionBy("r", "b").orderBy("h", "doc_id", "size")
    queued = (
        known.withColumn("here", F.sum("size").over(inside))
        .join(_small(groups, groups.count()), (F.col("r") == F.col("r2")) & (F.col("b") == F.col("b2")))
        .select("doc_id", "source", "size", "h", "r", "source_size", "target", "total", (F.col("ahead") + F.col("here")).alias("queued"))
    )
    queued = written(queued, "mix-queue")
    scratch.close()

    items = queued.where("size > 0").select("size", "r", "h", "doc_id", "total", F.explode(F.array(*[_finish(e) for e in range(most)])).alias("finish"))
    items = items.withColumn("slice", F.least(F.floor(F.col("finish") * slices), F.lit(4 * slices)))
    sums = items.groupBy("slice", "total").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(W.orderBy("slice")))
    # The slice in which the budget is reached; at most one row.
    edge = sums.where("upto > total and upto - words <= total").select("slice", (F.col("upto") - F.col("words")).alias("before"))
    order = W.partitionBy("slice").orderBy("finish", "r", "h", "doc_id", "size")
    key = F.struct("finish", "r", "h", "doc_id", "size")
    over = items.join(F.broadcast(edge), "slice").withColumn("sum", F.col("before") + F.sum("size").over(order)).where("sum > total")
    first_out = over.agg(F.min(key).alias("cut"))  # one row; null where all is taken
    epochs = sum(F.when(F.col("cut").isNull() | (F.struct(_finish(e).alias("finish"), "r", "h", "doc_id", "size") < F.col("cut")), 1).otherwise(0) for e in range(most))
    return (
        queued.crossJoin(F.broadcast(first_out))  # exactly one row on that side
        .withColumn("epochs", F.when(F.col("size") > 0, epochs).otherwise(0))
        .select("doc_id", "source", "size", "source_size", "target", "queued", "epochs", (F.col("size") * F.col("epochs")).alias("taken"))
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, range-sorted by virtual finish time."""
    names = docs.columns
    taken = plan(docs, weights, most).where("epochs > 0").select(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"), F.explode(F.transform(F.sequence(F.lit(0), F.col("epochs") - 1), lambda e: _finish(e))).alias("__mix_finish")).distinct()
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    found = docs.withColumn("__mix_words", size).join(taken, F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("__mix_words") == F.col("__mix_size")))
    return found.repartitionByRange("__mix_finish", "doc_id").sortWithinPartitions("__mix_finish", "doc_id").select(*names)


#: The same result by plain windows, for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'size ' || size)), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, source_size, r, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source)),
f AS (
  SELECT *, sum(source_size) OVER () AS total, sum(cap) OVER o - cap AS before, sum(weight) OVER () - sum(weight) OVER o + weight AS rest
  FROM s WINDOW o AS (ORDER BY cap / weight, r)),
g AS (SELECT *, (total - before) * weight >= cap * rest AS isfull FROM f),
t AS (
  SELECT source, source_size, r, total, CASE WHEN isfull THEN cap::DOUBLE ELSE
    (total - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ())::DOUBLE * weight / (sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target
  FROM g),
q AS (
  SELECT d.doc_id, d.size, d.h, t.r, t.source_size, t.target, t.total, sum(d.size) OVER (PARTITION BY t.r ORDER BY d.h, d.doc_id, d.size)::BIGINT AS queued
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (
  SELECT *, (e * source_size + queued)::DOUBLE / target AS finish FROM q, (VALUES (0), (1), (2)) v(e) WHERE size > 0),
c AS (SELECT doc_id, h, r, size, total, sum(size) OVER (ORDER BY finish, r, h, doc_id, size) AS upto FROM i),
k AS (SELECT doc_id, h, r, size, count(*) FILTER (upto <= total) AS epochs FROM c GROUP BY ALL),
n AS (SELECT doc_id, h, r, size, count(*) AS copies FROM q GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(k.epochs // n.copies, 0))::BIGINT AS taken
FROM q JOIN n ON q.doc_id IS NOT DISTINCT FROM n.doc_id AND q.r = n.r AND q.size = n.size
LEFT JOIN k ON q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.r = k.r AND q.size = k.size
"""

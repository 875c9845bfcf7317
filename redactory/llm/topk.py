"""Exact top-k search by inner product with a KD-tree per shard.

A KD-tree of median splits, fitted on a bounded sample of the candidates, deals them to cells; every cell's tight bounding
box is taken from all its candidates. A large cell is dealt on to shards of ``shard_rows`` rows at most. A shard's task builds
a KD-tree (median splits on the widest side, tight boxes) and answers each query best-first: nodes are visited by the largest
inner product their box allows, until that falls under the kth score. Queries visit cells in ROUNDS, best bound first: one
cell, then a few, then whatever is left; the kth score of the rounds before goes with them, and a cell whose box
allows less is never sent the query. The cells' boxes are all that tasks hold beside (CELLS boxes a vector length).
A task meets one shard and ``block_rows`` queries at most, whatever the size of the tables.

Boxes cut little in many dimensions, where every exact search comes near to all pairs; then the rounds still bound each task.

Defined results: vectors that are null, or hold a null or non-finite component, or have a null id take no part; vectors
meet those of their own length (lengths beyond the LENGTHS most frequent of the sample have one cell each, without a box); a row never answers a query of its own id; repeated candidate rows are each returned,
a repeated query once; ties go to the smaller id; fewer candidates than k give them all; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .session import Scratch, arrow_rows

LEAF, K = 128, 5
SAMPLE, CELLS, CELL_ROWS, LENGTHS, SHARD_ROWS = 2048, 256, 4096, 8, 65_536
#: How many cells a query has visited, best bound first, after each round.
ROUNDS = (1, 8, CELLS)
FOUND = "query_key long, query_id long, vec_id long, score long"
_FOUND = pa.schema([("query_key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class KDTree:
    """Rows of an integer matrix under median splits; node i has children 2i+1 and 2i+2 or a leaf's row range."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(ids))
        self.low, self.high, self.child, self.span = [], [], [], []
        self._build(vectors, 0, len(ids), leaf)
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.ids, self.vectors = ids[self.order], np.ascontiguousarray(vectors[self.order])

    def _build(self, vectors: np.ndarray, start: int, end: int, leaf: int) -> int:
        node, rows = len(self.child), self.order[start:end]
        held = vectors[rows]
        low, high = held.min(0), held.max(0)
        self.low.append(low)
        self.high.append(high)
        self.child.append(None)
        self.span.append((start, end))
        if end - start > leaf and (high > low).any():
            middle = (end - start) // 2
            self.order[start:end] = rows[np.argpartition(held[:, np.argmax(high - low)], middle)]
            self.child[node] = (self._build(vectors, start, start + middle, leaf), self._build(vectors, start + middle, end, leaf))
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with a point of each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bound: np.ndarray, own: int, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best with a score of ``kth`` or more; bound: the query's row of bounds()."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        heap = [(-bound[0], 0)]
        while heap:
            most, node = heapq.heappop(heap)
            if -most < kth:
                break
            if self.child[node]:
                for c in self.child[node]:
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            start, end = self.span[node]
            got = self.vectors[start:end] @ query
            take = np.flatnonzero(got >= kth)
            take = take[self.ids[start:end][take] != own]
            if len(take):
                ids, scores = np.concatenate([ids, self.ids[start:end][take]]), np.concatenate([scores, got[take]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    kth = max(kth, scores[-1])
        return ids, scores


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks()
    array = array if isinstance(array, pa.Array) else pa.concat_arrays(array.chunks)
    return np.asarray(array.flatten()).reshape(len(array), -1)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As doubles where every sum of products is exact in them, else as 64-bit integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return a.astype(np.float64), b.astype(np.float64)
    return a, b


def _answer(k: int):
    def answer(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        points, asked = _exact(_matrix(candidates.column("v")), _matrix(queries.column("v")))
        tree = KDTree(candidates.column("vec_id").to_numpy(), points)
        keys, own, kth = (queries.column(c).to_numpy() for c in ("query_key", "query_id", "kth"))
        out = []
        for at in range(0, len(asked), 512):
            bounds = tree.bounds(asked[at : at + 512])
            for i in range(at, min(at + 512, len(asked))):
                ids, scores = tree.search(asked[i], bounds[i - at], own[i], k, kth[i])
                out.append((np.full(len(ids), keys[i]), np.full(len(ids), own[i]), ids, scores.astype(np.int64)))
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], schema=_FOUND)

    return answer


@dataclass
class Cells:
    """Median splits by vector length, as a complete binary tree of (component, threshold), and the cells' boxes."""

    splits: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    boxes: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def fitted(cls, sample: list[list[int]], cells: int) -> Cells:
        out = cls()
        sizes = Counter(map(len, sample))
        for dim, n in sorted(sizes.items(), key=lambda s: (-s[1], s[0]))[:LENGTHS]:
            rows = np.array([v for v in sample if len(v) == dim])
            depth = max(0, int(np.log2(max(1, min(cells, n // 8)))))
            part, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1, np.int64)
            held = {0: rows}
            for node in range(len(part)):
                own = held.pop(node)
                part[node] = np.argmax(own.max(0) - own.min(0)) if len(own) else 0
                value[node] = np.sort(own[:, part[node]])[(len(own) - 1) // 2] if len(own) else 0
                left = own[:, part[node]] <= value[node]
                held[2 * node + 1], held[2 * node + 2] = own[left], own[~left]
            out.splits[dim] = part, value
        return out

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector; -1 for lengths without splits."""
        dim = vectors.shape[1]
        if dim not in self.splits:
            return np.full(len(vectors), -1)
        part, value = self.splits[dim]
        node = np.zeros(len(vectors), np.int64)
        for _ in range((len(part) + 1).bit_length() - 1):
            node = 2 * node + 1 + (vectors[np.arange(len(vectors)), part[node]] > value[node])
        return node - len(part)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product of each query with a point of each cell's box; nothing for empty cells."""
        low, high = self.boxes[queries.shape[1]]
        most = np.maximum(queries, 0).astype(np.float64) @ high.T + np.minimum(queries, 0).astype(np.float64) @ low.T
        # Sums of doubles may fall short of an integer score by rounding, so bounds are taken a little larger.
        return np.where(np.isnan(most), -np.inf, most + np.abs(most) * 1e-9 + 1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = batch.take(pa.array(np.flatnonzero(dims == dim)))
        yield int(dim), part, np.asarray(part.column("v").flatten()).reshape(part.num_rows, -1)


def _celled(cells: Cells):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part, v in _by_length(batch):
                yield part.append_column("cell", pa.array(cells.of(v).astype(np.int32)))

    return run


def _boxes(points: DataFrame, cells: Cells) -> None:
    """Fills in the boxes of all cells; LENGTHS x CELLS x 2 vectors come to the driver from each wave of merging."""

    def merged(groups: dict, dim: int, cell: int, low: np.ndarray, high: np.ndarray) -> None:
        had = groups.get((dim, cell))
        groups[dim, cell] = (low, high) if had is None else (np.minimum(had[0], low), np.maximum(had[1], high))

    def pack(groups: dict) -> pa.RecordBatch:
        columns = [pa.array([d for d, _ in groups], pa.int32()), pa.array([c for _, c in groups], pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([b[i].tolist() for b in groups.values()], pa.list_(pa.int64())) for i in (0, 1))], ["dim", "cell", "low", "high"])

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        for batch in batches:
            for dim, part, v in _by_length(batch):
                at = part.column("cell").to_numpy()
                for cell in np.unique(at[at >= 0]):
                    own = v[at == cell]
                    merged(groups, dim, int(cell), own.min(0), own.max(0))
        yield pack(groups)

    def final(table: pa.Table) -> pa.Table:
        groups: dict = {}
        for r in table.to_pylist():
            merged(groups, r["dim"], r["cell"], np.array(r["low"]), np.array(r["high"]))
        return pa.Table.from_batches([pack(groups)])

    schema = "dim int, cell int, low array<long>, high array<long>"
    for r in points.mapInArrow(partial, schema).groupBy("dim", "cell").applyInArrow(final, schema).toLocalIterator():
        count = len(cells.splits[r["dim"]][0]) + 1
        low, high = cells.boxes.setdefault(r["dim"], (np.full((count, r["dim"]), np.nan), np.full((count, r["dim"]), np.nan)))
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]


ASKED = "query_key long, query_id long, v array<long>, dim int, kth double"


def _visits(cells: Cells, begin: int, end: int):
    """Of each query the cells that come begin-th to end-th by their bounds, if a point there can still reach the kth score."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, v in _by_length(batch):
                if dim not in cells.boxes:
                    if not begin:
                        yield part.append_column("cell", pa.array(np.full(part.num_rows, -1, np.int32)))
                    continue
                most = cells.bounds(v)
                order = np.argsort(-most, axis=1, kind="stable")[:, begin:end]
                bound = np.take_along_axis(most, order, 1)
                row, place = np.nonzero((bound > -np.inf) & (bound >= part.column("kth").to_numpy()[:, None]))
                yield part.take(pa.array(row)).append_column("cell", pa.array(order[row, place].astype(np.int32)))

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int | None = None, block_rows: int = 16_384, cells: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for each of ``queries`` (both vec_id, embedding)."""
    spark, shard_rows = vectors.sparkSession, shard_rows or SHARD_ROWS
    arrow_rows(spark)

    def clean(df: DataFrame) -> DataFrame:
        whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
        df = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(whole)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")).withColumn("dim", F.size("v"))

    points, scratch = clean(vectors), Scratch(spark, "topk")
    cells = min(CELLS, cells or max(1, vectors.count() // CELL_ROWS))
    sample = [r["v"] for r in points.select("v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).collect()]
    plan = Cells.fitted(sample, cells)
    points = scratch.write(points.mapInArrow(_celled(plan), "vec_id long, v array<long>, dim int, cell int"), "points")
    _boxes(points, plan)

    # At most LENGTHS x CELLS rows; lengths without cells share one row's number of shards.
    sizes = points.groupBy(F.when(F.col("cell") >= 0, F.col("dim")).alias("dim"), "cell").agg(F.count("*").alias("n")).collect()
    pieces = {(r["dim"], r["cell"]): -(-r["n"] // shard_rows) for r in sizes}
    asked = clean(queries).dropDuplicates().select(F.xxhash64("vec_id", "v").alias("query_key"), F.col("vec_id").alias("query_id"), "v", "dim", F.lit(float("-inf")).alias("kth"))
    asked = scratch.write(asked, "queries")
    order = W.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    found = None
    for begin, end in zip((0, *ROUNDS), ROUNDS, strict=False):
        now = asked
        if found is not None:
            known = found.groupBy("query_key").agg(F.count("*").alias("had"), F.min("score").cast("double").alias("least")).where(F.col("had") >= k)
            now = asked.drop("kth").join(known, "query_key", "left").select("query_key", "query_id", "v", "dim", F.coalesce("least", F.lit(float("-inf"))).alias("kth"))
        visits = scratch.write(now.mapInArrow(_visits(plan, begin, end), f"{ASKED}, cell int"), "visits")
        wanted = visits.groupBy(F.when(F.col("cell") >= 0, F.col("dim")).alias("dim"), "cell").agg(F.count("*").alias("n")).collect()
        rows = [(r["dim"], r["cell"], pieces.get((r["dim"], r["cell"]), 0), -(-r["n"] // block_rows)) for r in wanted]
        deal = spark.createDataFrame(rows, "of int, at int, pieces int, blocks int")
        near = lambda df: df.join(F.broadcast(deal), (F.col("cell") == F.col("at")) & ((F.col("cell") < 0) | (F.col("dim") == F.col("of")))).where("pieces > 0")  # noqa: B023, E731
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = near(points).withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int")).withColumn("block", upto("blocks"))
        right = near(visits).withColumn("block", F.pmod("query_key", F.col("blocks")).cast("int")).withColumn("piece", upto("pieces"))
        keys = ("dim", "cell", "piece", "block")
        got = left.select("vec_id", "v", *keys).groupBy(*keys).cogroup(right.select("query_key", "query_id", "v", "kth", *keys).groupBy(*keys)).applyInArrow(_answer(k), FOUND)
        got = got if found is None else found.unionByName(got)
        found = scratch.write(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "found")
    out = Scratch(spark, "topk-found").write(found.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score"), "found")
    scratch.close()
    return out


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

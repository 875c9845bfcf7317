"""A quality classifier by Bradley-Terry pairwise ranking.

Documents are strengths w.x of features of their whole text; the chance that one is preferred over another is the
logistic function of the difference of their strengths. Preference pairs, a document of label 1 over one of label 0,
fit w by logistic loss on feature differences (Newton's method with a ridge). Training takes a bounded sample
(``per_label`` documents of each label and ``pairs`` pairs, both parameters). One pass over all texts then gives their
strengths; the threshold is the quantile of the strengths of all rows that may be learned from at the share of label 0
among them, from a histogram of ``BINS`` bins, and scores are scaled so that it falls on ``cut``.

Features are counts of bytes by class, of words by shape, of distinct words and of repeated lines and windows, from one
pass over all texts without a shuffle. Defined results: a null or empty text has the features of no words and is scored
like any other; without labels of both kinds every score is 0.5; repeated rows get equal scores; repeated label rows
weigh once, and however often an id is repeated no more than about ``per_label`` of its rows are sampled; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learn import histogram, remainder, sample, sampled_rows
from .rules import base_counts
from .session import Scratch, arrow_rows
from .words import Words, mix, slices, sums

PER_LABEL, PAIRS, CUT, BINS = 2048, 16_384, 0.3, 4096
SCHEMA = "doc_id long, strength double"
#: Byte classes: each ASCII symbol for itself, then digits, capitals, small letters, line ends, other white space, other bytes.
_SYMBOLS = [k for k in range(33, 127) if not chr(k).isalnum()]
_CLASS = np.full(256, len(_SYMBOLS) + 5, np.uint8)
for _i, _k in enumerate(_SYMBOLS):
    _CLASS[_k] = _i
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[10], _CLASS[[9, 11, 12, 13, 32]] = (len(_SYMBOLS) + k for k in range(5))
CLASSES = len(_SYMBOLS) + 6


def features(texts: pa.Array) -> np.ndarray:
    w, rows = Words(texts), len(texts)
    size = np.diff(w.offsets)
    kind = _CLASS[w.raw]
    share = np.array([np.bincount(kind[a:b], minlength=CLASSES) for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]).reshape(rows, CLASSES) / np.maximum(size, 1)[:, None]
    n = np.maximum(w.counts, 1)
    length = w.ends - w.starts
    letter = (kind == len(_SYMBOLS) + 2) | (kind == len(_SYMBOLS) + 5)
    capital, symbol = kind == len(_SYMBOLS) + 1, kind < len(_SYMBOLS)
    within = lambda mask: np.diff(np.append(np.int32(0), np.cumsum(mask, dtype=np.int32))[np.stack([w.starts, w.ends])], axis=0)[0]
    small, caps, marks = within(letter), within(capital), within(symbol)
    shapes = [length == 1, length > 14, small == 0, (caps > 0) & (small == 0), (caps > 0) & (small > 0), marks == length, marks > 1, capital[w.starts] if len(w) else np.zeros(0, bool), symbol[w.ends - 1] if len(w) else np.zeros(0, bool)]
    shapes = [sums(x, w.first) / n for x in shapes]
    hashes = mix(w.hashes() + mix(w.rows().astype(np.uint64)))
    _, where = np.unique(hashes, return_index=True)
    distinct = np.bincount(w.rows()[where], minlength=rows) / n
    base = base_counts(texts)
    lines = sums(w.raw == 10, w.offsets)
    more = [np.log1p(w.counts), np.log1p(size), sums(length, w.first) / n, distinct, base["n_repeat_words"] / n, base["n_dup_lines"] / (lines + 1), lines / n]
    return np.column_stack([np.sqrt(share), *shapes, *more]).astype(np.float64)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def most(self) -> float:
        """No strength lies farther from 0."""
        return 6 * float(np.abs(self.weights).sum()) + 1e-9

    def score(self, strength: Column) -> Column:
        z = self.slope * (strength - self.threshold) + float(np.log(self.cut / (1 - self.cut)))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights that minimise logistic loss."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, cut: float = CUT) -> Model:
    """Weights from preference pairs of sampled rows, and how steep scores rise; the threshold is set later, over all rows."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    choose = np.random.default_rng(0)
    d = z[choose.choice(good, pairs)] - z[choose.choice(bad, pairs)]
    model = Model(mean, scale, _newton(d, np.ones(pairs), ridge=pairs / 2000), 0.0, 1.0, cut)
    s = model.strength(x)
    slope = float(np.clip(_newton(np.column_stack([s - s.mean(), np.ones(len(s))]), label, 1e-3)[0], 0.05, 20))
    return replace(model, slope=slope)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, pairs: int = PAIRS, cut: float = CUT) -> Model | None:
    """labels: (doc_id, quality) rows that may be learned from, each once. The sample's features come to the driver: 2 x per_label rows of them."""

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("quality").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "x"])

    chosen = sample(labels, "quality", per_label)
    rows = sampled_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chosen, ["doc_id"], "quality", per_label)
    rows = rows.select("quality", "text").mapInArrow(measure, "quality int, x binary").collect()
    rows.sort()
    if len({r["quality"] for r in rows}) < 2:
        return None
    return fit(np.stack([np.frombuffer(r["x"]) for r in rows]), np.array([r["quality"] for r in rows]), pairs, cut)


def strengths(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and strength of every text."""

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(model.strength(features(part.column("text"))))], ["doc_id", "strength"])

    return docs.select("doc_id", "text").mapInArrow(predict, SCHEMA)


def with_threshold(model: Model, told: DataFrame, labels: DataFrame) -> Model:
    """The model with its threshold: the quantile of the strengths of all labelled rows at the share of label 0 among them."""
    rows = told.join(labels, "doc_id").select("quality", "strength")
    total = np.zeros((2, BINS), np.int64)
    for r in histogram(rows, ["quality"], F.col("strength"), -model.most(), model.most(), BINS).collect():
        total[r["quality"], r["bin"]] = r["n"]
    upto = total.sum(0).cumsum()
    under = int((upto <= total[0].sum()).sum())  # bins that lie under the quantile as a whole
    return replace(model, threshold=model.most() * (2 * under / BINS - 1))


def fitted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains on labels whose crc32 remainder by 5 is not 0 and scores every row."""
    arrow_rows(docs.sparkSession)
    labels = labels.where((remainder("doc_id", 5) != 0) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    model = train(docs, labels)
    if model is None:
        told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.5).alias("score"))
    else:
        written = Scratch(docs.sparkSession, "preference").write(strengths(docs, model), "strengths")
        told = written.select("doc_id", with_threshold(model, written, labels).score(F.col("strength")).alias("score"))
    return told.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))

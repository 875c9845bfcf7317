"""Language identification by nearest clustered centroids.

A text is the vector of its letters' byte trigrams, words set apart by one space (hashed to 2^BITS dimensions), weighted by log term frequency and inverse
document frequency and scaled to length 1. Document frequencies are counted over all texts that may be learned from. From a bounded sample of them
(``per_label`` of each language, a parameter) each language's vectors are clustered into ``clusters`` centroids by spherical k-means, one language a task.
The cut beyond which a text is rejected comes from all learnable texts again: the ``quantile`` of their cosines to the nearest centroid, by language,
from a histogram of ``BINS`` bins; the distance, -log of the cosine, may be ``slack`` times that, so the cut never falls to cosine 0. Texts of fewer than
``short`` trigrams are neither in the histogram nor rejected by distance: theirs tells nothing. Prediction is one pass over all texts without a shuffle.

The driver holds the model alone: 2^BITS frequencies, and for each language its centroids and cut, about 100 KB; more than LANGUAGES different languages
are an error, not a smaller model.

Defined results: null or letterless text: ``und``, score 0, rejected; text of a single letter has a zero vector and
falls to the first language with score 0; ties go to the first language in order; no labelled rows: all texts are
``und``; a language with fewer learnable texts of ``short`` trigrams than have a ``quantile`` (100 for 0.01) rejects none by distance; repeated rows get equal results, and however often an id
is repeated no more than about ``per_label`` of its rows are sampled; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import histogram, letters, remainder, sample, sampled_rows, trigrams
from .session import arrow_rows, frugal, settled
from .words import buffers, slices

BITS, PER_LABEL, CLUSTERS = 13, 512, 3
#: Texts of fewer trigrams than this are too short for their distance to tell anything; they are not rejected by it.
SHORT = 64
QUANTILE, SLACK, BINS = 0.01, 1.5, 2000
LANGUAGES = 1000
LETTER = regex.compile(r"\p{L}")
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    #: centroids, dims x n, idf folded in; owner: the language number of each
    centroids: np.ndarray
    owner: np.ndarray
    #: smallest cosine that a text of each language may have
    least: np.ndarray
    short: int = SHORT


def counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the trigrams it has and how often."""
    raw, offsets = letters(*buffers(texts))
    codes = trigrams(raw, BITS) if len(raw) > 2 else np.zeros(0, np.int32)
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        count = np.bincount(codes[start : max(start, end - 2)], minlength=1 << BITS)
        at = np.flatnonzero(count)
        yield at, count[at]


def _frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Texts, and how many hold each trigram, over all of them; 2^BITS + 1 sums come to the driver."""

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + (1 << BITS), np.int64)
        for batch in batches:
            for part in slices(batch):
                for at, _ in counts(part.column("text")):
                    total[at] += 1
                total[-1] += part.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    total = np.zeros(1 + (1 << BITS), np.int64)
    for row in texts.mapInArrow(frugal(tally), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[row["at"]] = row["n"]
    return int(total[-1]), total[:-1]


def train(labels: DataFrame, per_label: int = PER_LABEL, clusters: int = CLUSTERS, quantile: float = QUANTILE, slack: float = SLACK, short: int = SHORT) -> Model:
    """labels: rows (doc_id, text, lang) that may be learned from, all with a language."""
    arrow_rows(labels.sparkSession)
    n, held = _frequencies(labels.select("text"))
    idf = np.log((1 + n) / (1 + held)).astype(np.float32) + 1

    def cluster(table: pa.Table) -> pa.Table:
        found = list(counts(table.column("text").combine_chunks()))
        x = np.zeros((len(found), 1 << BITS), np.float32)
        for row, (at, count) in zip(x, found, strict=True):
            row[at] = (1 + np.log(count)) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        x = x[np.lexsort((x.argmax(1), x.sum(1)))]  # an order that does not hang on how rows arrive
        centers = _kmeans(x, min(clusters, len(x)))
        return pa.table([pa.array([table.column("lang")[0].as_py()] * len(centers)), pa.array([c.astype("<f4").tobytes() for c in centers], pa.binary())], ["lang", "center"])

    rows = sampled_rows(labels, sample(labels, "lang", per_label), ["doc_id", "lang"], "lang", per_label)
    made = rows.groupBy("lang").applyInArrow(frugal(cluster), "lang string, center binary").limit(clusters * LANGUAGES + 1).collect()
    if len({r["lang"] for r in made}) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn: is the language column one?")
    made.sort(key=lambda r: (r["lang"], r["center"]))
    languages = sorted({r["lang"] for r in made})
    centroids = np.stack([np.frombuffer(r["center"], "<f4") for r in made]) if made else np.zeros((0, 1 << BITS), np.float32)
    owner = np.array([languages.index(r["lang"]) for r in made], np.int64)
    model = Model(languages, idf, np.ascontiguousarray((centroids * idf).T), owner, np.zeros(len(languages)), short)
    return replace(model, least=_cuts(labels, model, quantile) ** slack) if languages else model


def _cuts(labels: DataFrame, model: Model, quantile: float) -> np.ndarray:
    """Of each language the quantile of its learnable texts' cosines, over those that are nearest to it; LANGUAGES x BINS sums at most come to the driver."""
    held = labels.sparkSession.sparkContext.broadcast(model)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                best, cosine, size = scores(part.column("text"), held.value)
                named = np.array(held.value.languages, object)[best]
                own = (size >= held.value.short) & (named == np.array(part.column("lang").to_pylist(), object))
                yield pa.RecordBatch.from_arrays([pa.array(best[own]), pa.array(cosine[own])], ["language", "cosine"])

    rows = histogram(labels.select("text", "lang").mapInArrow(frugal(near), "language long, cosine double"), ["language"], F.col("cosine"), 0.0, 1.0, BINS).collect()
    total = np.zeros((len(model.languages), BINS), np.int64)
    for r in rows:
        total[r["language"], r["bin"]] = r["n"]
    upto = total.cumsum(1)
    # The lower end of the first bin that the quantile does not leave out; too few texts have no such quantile.
    return np.where(quantile * upto[:, -1] >= 1, (upto <= quantile * upto[:, -1:]).sum(1) / BINS, 0.0)


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from rows far from each other."""
    centers = x[:1]
    while len(centers) < k:
        centers = np.concatenate([centers, x[[np.argmin((x @ centers.T).max(1))]]])
    for _ in range(rounds):
        near = (x @ centers.T).argmax(1)
        centers = np.stack([x[near == j].mean(0) if (near == j).any() else centers[j] for j in range(k)])
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def scores(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the nearest language's number, the cosine, and the number of trigrams."""
    n = len(texts)
    best, cosine, size = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
    for k, (at, count) in enumerate(counts(texts)):
        if len(at):
            tf = 1 + np.log(count.astype(np.float32))
            norm = np.linalg.norm(tf * model.idf[at])
            near = tf @ model.centroids[at] / norm
            j = int(near.argmax())
            best[k], cosine[k], size[k] = model.owner[j], near[j], count.sum()
    return best, cosine, size


def _predict(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the language's name, the score, and whether it is rejected."""
    lettered = np.array([bool(t and LETTER.search(t)) for t in texts.to_pylist()], bool)
    if not model.languages:
        return np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
    best, cosine, size = scores(texts, model)
    named, far = np.array(model.languages, object)[best], (cosine < model.least[best]) & (size >= model.short)
    return np.where(lettered, named, "und"), np.where(lettered, np.clip(cosine, 0, 1), 0.0), ~lettered | far


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid) and rejected for every text."""
    arrow_rows(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                named, score, far = _predict(part.column("text"), held.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(named, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(frugal(predict), SCHEMA)


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not rejected, as they are; no shuffle."""
    arrow_rows(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(~_predict(part.column("text"), held.value)[2]))

    return docs.mapInArrow(frugal(keep), docs.schema)


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that a model of its own labelled rows does not reject."""
    model = train(labelled(docs))
    settled(docs.sparkSession)
    return kept(docs, model)


def labelled(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: a language, and a crc32 remainder by 4 other than 2."""
    return docs.where(F.col("lang").isNotNull() & (remainder("doc_id", 4) != 2)).select("doc_id", "text", "lang")


def fitted(docs: DataFrame) -> DataFrame:
    """Trains on the labelled rows of docs and predicts every row."""
    return identify(docs, train(labelled(docs))).withColumn("held_out", remainder("doc_id", 4) == 2)

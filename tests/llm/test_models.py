"""Trained operators: held-out accuracy, rejection, and odd tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from redactory.llm import language, learn, preference
from redactory.llm.words import buffers

from . import brute

DIR = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = language.fitted(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got) and all(r.score < 0.3 for r in got if r.rejected and r.n_chars > 200) and sum(r.rejected for r in got if r.n_chars > 200) <= 1


def test_language_of_odd_texts(spark):
    train = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(language.labelled(train))
    noise = "".join(chr(97 + k * k * 7919 % 23) + ("q" if k % 3 else "zx ") for k in range(600))
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !!", "x"), (4, "a", "x"), (5, noise, "x"), (5, noise, "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].rejected and got[k].score == 0 for k in (1, 2, 3))
    assert got[4].lang_pred in model.languages and not got[4].rejected and got[5].rejected
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.fitted(nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_far_texts_are_rejected_whatever_is_nearest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.train(language.labelled(docs))
    assert len(model.least) == 4 and min(model.least) > 0.15
    rng = np.random.default_rng(0)
    noise = lambda letters, n: " ".join("".join(rng.choice(list(letters), n)) for _ in range(150))
    far = {
        "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı.",
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván.",
        "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
        "keys": noise("asdfghjkl", 7), "keys2": noise("qwertyuiopzxcvbnm", 5), "letters": noise("abcdefghijklmnopqrstuvwxyz", 6), "accents": noise("éèñóößüç", 6),
        "hex": " ".join(rng.bytes(8).hex() for _ in range(80)), "base64": noise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 60),
    }
    best, _, size = language.scores(pa.array(list(far.values())), model)
    assert len(set(best)) >= 3 and min(size) >= language.SHORT
    assert language._predict(pa.array(list(far.values())), model)[2].all()
    got = language.identify(docs, model).join(docs.select("doc_id", "n_chars"), "doc_id").where("n_chars > 200").agg(F.avg(F.col("rejected").cast("int"))).first()
    assert got[0] < 0.001


def test_learning_ignores_what_is_held_out(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.fitted(d).collect()} for d in (docs, other))
    assert a == b


def test_letters():
    raw, offsets = learn.letters(*buffers(pa.array(["Ab!  c\n9D", None, "Üx"])))
    assert [raw[x:y].tobytes().decode() for x, y in zip(offsets[:-1], offsets[1:], strict=True)] == [" ab c d", " ", " üx"]


def test_sample_is_bounded_and_even(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("lang"))
    got = {r.lang: r["count"] for r in learn.sample(rows, "lang", 320).groupBy("lang").count().collect()}
    assert got == {"a": 320, "b": 320}


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    got = preference.fitted(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert len(bad) > 3 and np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9 and all(r.predicted == (r.score >= 0.3) for r in got)


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (2, "", 1), (3, "x", 0)], "doc_id long, text string, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in preference.fitted(docs, none).collect()} == {0.5}
    labels = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "quality").distinct()
    model = preference.train(spark.read.parquet(f"{DIR}/documents.parquet"), labels)
    got = preference.strengths(docs, model).select(model.score(F.col("strength")).alias("s")).collect()
    assert len(got) == 4 and all(0 <= r.s <= 1 for r in got)
    assert preference.strengths(docs.limit(0), model).count() == 0


def test_pairs_rank_by_strength(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x @ [2, -1, 0, 0] + rng.normal(size=600) > -1).astype(int)
    model = preference.fit(x, y, pairs=4000)
    told = spark.createDataFrame([(k, float(s)) for k, s in enumerate(model.strength(x))], "doc_id long, strength double")
    model = preference.with_threshold(model, told, spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int"))
    s = np.array([r.s for r in told.orderBy("doc_id").select(model.score(F.col("strength")).alias("s")).collect()])
    assert np.mean(s[y == 1][:, None] > s[y == 0][None]) > 0.9 and abs(np.mean(s < 0.3) - np.mean(y == 0)) < 0.02
    exact = np.sort(model.strength(x))[(y == 0).sum()]
    assert abs(model.threshold - exact) <= 2 * model.most() / preference.BINS


def test_strengths_against_brute_force():
    """Features of texts, one character at a time."""
    texts = ["Hello there, general Kenobi! 42%", "a\n\na\nb  c", "", None, "ÀÉ x_y #tag\tABC supercalifragilistic supercalifragilistic"]
    got = preference.features(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, brute.quality_features(text or "", preference._SYMBOLS)), text


def test_nearest_centroid_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id % 10 = 0")
    model = language.train(language.labelled(docs), per_label=20)
    rows = docs.limit(60).collect()
    best, cosine, size = language.scores(pa.array([r.text for r in rows]), model)
    for r, b, c, n in zip(rows, best, cosine, size, strict=True):
        far = brute.nearest(brute.trigram_codes(r.text, language.BITS), model.idf, model.centroids, model.owner)
        assert (far[0], far[2]) == (b, n) and abs(far[1] - c) < 1e-4


def test_frequencies_and_cuts_cover_all_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = language.labelled(docs)
    n, held = language._frequencies(labels.select("text"))
    rows = labels.collect()
    assert n == len(rows)
    total = np.zeros(1 << language.BITS, np.int64)
    for r in rows:
        total[sorted(set(brute.trigram_codes(r.text, language.BITS)))] += 1
    assert (held == total).all()
    model = language.train(labels)
    cosines = {k: [] for k in model.languages}
    for r, b, c, size in zip(rows, *language.scores(pa.array([r.text for r in rows]), model), strict=True):
        if size >= model.short and model.languages[b] == r.lang:
            cosines[r.lang].append(c)
    for k, least in zip(model.languages, model.least, strict=True):
        exact = np.sort(cosines[k])[int(language.QUANTILE * len(cosines[k]))] if language.QUANTILE * len(cosines[k]) >= 1 else 0
        assert abs(least ** (1 / language.SLACK) - exact) < 2 / language.BINS


def test_training_is_bounded(spark):
    """An id on very many rows, and very many languages, don't fill the driver."""
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert learn.sampled_rows(same, learn.sample(same, "lang", 64), ["doc_id", "lang"], "lang", 64).count() <= 64 + learn.SALTS
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(chr(97 + k)), (F.col("id") % 500).cast("string"), F.lit("words of it")) for k in range(3)]).alias("text"), (F.col("id") % 500).cast("string").alias("lang"))
    model = language.train(many, per_label=32)
    assert len(model.languages) == 500 and model.centroids.nbytes < 100_000 * 500
    with pytest.raises(ValueError, match="languages"):
        language.train(many.withColumn("lang", F.col("doc_id").cast("string")), per_label=32)

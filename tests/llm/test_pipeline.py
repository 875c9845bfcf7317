"""The pipeline's stages in a row, and the registered queries."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from redactory.llm import queries

from . import brute

DIR = "/root/testdata/sf0.001"


def test_names():
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "mixing", "packing"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, DIR)
    assert kept.columns == names and kept.count() >= 0.98 * docs.count()

    near = stages["near_duplicates"](spark, kept, DIR)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert {r.doc_id for r in near.collect()} == set(brute.near_classes(rows).values()) and near.columns == names

    cut = stages["substring_dedup"](spark, near, DIR)
    expected = brute.substrings([(r.doc_id, r.text) for r in near.collect()])
    got = {r.doc_id: r for r in cut.collect()}
    assert {i: " ".join(brute.words(r.text)) for i, r in got.items()} == {i: x[3] for i, x in expected.items() if not x[1] or x[1] < x[0]}
    assert cut.columns == names and all(r.n_chars == len(r.text) for r in got.values())

    mix = stages["mixing"](spark, cut, DIR)
    assert mix.columns == names and max(r["count"] for r in mix.groupBy("doc_id").count().collect()) <= 3
    total = sum(len(brute.words(r.text)) for r in mix.collect())
    assert abs(total - sum(len(brute.words(r.text)) for r in got.values())) <= max(len(brute.words(r.text)) for r in got.values())

    packed = stages["packing"](spark, mix, DIR).collect()
    assert sum(r.n_words for r in packed) == total


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids and texts, empty and very long texts, and columns with names that stages use themselves."""
    base = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source").limit(60).collect()]
    long = " ".join(f"word{k % 977} and{k % 13}" for k in range(30_000))
    odd = [(None, None, None, None), (None, "", "en", "s"), (None, base[0][1], "en", None), (None, base[1][1] + " more", None, "s"), (7001, long, "en", "s"), (7002, "   ", "fr", "s"), (7003, None, "en", "s"), base[5], base[5], (base[6][0], "another text under an id that is taken", "en", "s"), (7004, "12 34", "en", "s")]
    rows = [(*r, len(r[1] or ""), k, "x", k) for k, r in enumerate(base + odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, node string, h long")
    stages, counts = dict(corpus_pipeline.STAGES), {}
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in stages.items():
            path = str(tmp_path / f"{name}-{given is docs}")
            stage(spark, now, DIR).write.parquet(path)
            after = spark.read.parquet(path)
            if name != "packing":
                assert after.columns == docs.columns
            now, counts[name, given is docs] = after, after.count()
        assert given is docs or now.count() == 0
    kept = spark.read.parquet(str(tmp_path / "language_id-True"))
    # Language ID lets go of what has no letters; a text without words or id is nobody's near copy.
    assert counts["language_id", True] == len(rows) - 5 and kept.where("doc_id = 7001").count() == 1
    near = spark.read.parquet(str(tmp_path / "near_duplicates-True"))
    assert near.where(f"doc_id = {base[5][0]}").count() == 3 and near.where(f"doc_id = {base[6][0]}").count() == 2
    cut = spark.read.parquet(str(tmp_path / "substring_dedup-True"))
    assert cut.where("text is null or trim(text) = ''").count() == 0 and cut.where("doc_id = 7001").count() == 1


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    expected = c.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in expected.description)
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == names
    key = lambda row: tuple(str(row[n]) for n in names)
    columns = [d[0] for d in expected.description]
    assert sorted(key(r.asDict()) for r in got.collect()) == sorted(key(dict(zip(columns, r, strict=True))) for r in expected.fetchall())

"""Operators that read whole texts: words, quality rules, substring and near duplicates."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redactory.llm import neardup, rules, substrings
from redactory.llm.words import Words
from redactory.llm.sieve import sifted, with_figure, with_lookup
from redactory.llm.words import Words

from . import brute

DIR = "/root/testdata/sf0.001"
ODD = [None, "", "  \x0b\t\n", "x", "a b c d e f g h i j k l m", "　 z\xa0y", "a\n\na\na b c a b c", "x" * 5000, "ä" * 70 + " é"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bands string, part string, chunk string, copies string"


def rows_of(texts):
    return [(i, t, None, None, None, "b", "p", "c", "k") for i, t in enumerate(texts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\t\x0b\xa0é😀|#", max_size=60)), max_size=8))
def test_words_and_counts(texts):
    array = pa.array(texts, pa.string())
    w = Words(array)
    assert [w.raw[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends, strict=True)] == [x for t in texts for x in brute.words(t)]
    h = w.hashes()
    named = {}
    for a, b, x in zip(w.starts, w.ends, h.tolist(), strict=True):
        assert named.setdefault(w.raw[a:b].tobytes(), x) == x
    assert len(set(named.values())) == len(named)
    got = rules.base_counts(array)
    for k, t in enumerate(texts):
        assert tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute.base_counts(t)[:5]


def test_long_words_hash_apart():
    texts = ["x" * n for n in (7, 8, 9, 16, 127, 128, 129, 4000, 4001)] + ["y" + "x" * 200, "x" * 200 + "y"]
    assert len(set(Words(pa.array(texts)).hashes().tolist())) == len(texts)


def test_quality_rules(spark):
    docs = spark.createDataFrame(rows_of(ODD), DOCS).unionByName(spark.read.parquet(f"{DIR}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100), allowMissingColumns=True)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = rules.quality(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_counts(texts[r.doc_id])
        n, ratio, share, entropy = rules.fertility(texts[r.doc_id] or "", rules.VOCABULARY)
        assert r.kept == (not r.base_failed and rules.passes(n, ratio, share, entropy, rules.SCRIPTS[r.script][1]))
    assert rules.quality(docs.limit(0)).count() == 0
    assert rules.fertility("hello world hello", rules.VOCABULARY)[0] == 3
    assert rules.script_of("привет мир") == "cyrillic" and rules.script_of("日本") == "cjk" and rules.script_of("12") == "latin"


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_fertility_against_brute_force(vocabulary):
    path = f"/opt/tokenizers/{vocabulary}.tiktoken"
    texts = ["Hello there, isn't it 42?\n\n  Indeed!", "naïve café — 日本語 の 文 😀 x", "aaaa " * 30, "a\tb  c   d\r\ne ", "", "Ελληνικά και русский текст", "\u0301\u0489 %%% ***"]
    for text in texts:
        assert np.allclose(rules.fertility(text, path), brute.fertility(text, path, rules.PATTERN)), text


def test_pieces_change_no_token():
    """A long text has the tokens that it has as a whole, wherever it is cut."""
    rng = random.Random(4)
    parts = ["word", " ", "  ", "\n", " \n ", "don't", "42", "é", "日本", "!?", "\t", " x", "\u00a0y", "'s"]
    encoding = rules._encoding(rules.VOCABULARY)[0]
    for size in (1, 5, 40):
        text = "".join(rng.choice(parts) for _ in range(4000))
        got = list(rules.pieces(text, size))
        assert "".join(got) == text and len(got) > 3
        assert [t for x in got for t in encoding.encode_ordinary(x)] == encoding.encode_ordinary(text)
    long = "some words of a text that goes on, " * 15_000
    assert len(long) > 2 * rules.PIECE and len(list(rules.pieces(long))) > 2
    assert rules.fertility(long, rules.VOCABULARY)[0] == len(encoding.encode_ordinary(long))


def test_fertility_rejects_noise():
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("̀́҉⃝\U0001f9ff\U000e0041") for _ in range(6)) for _ in range(80))
    same = "aaaa " * 100
    band = rules.SCRIPTS["latin"][1]
    assert not rules.passes(*rules.fertility(noise, rules.VOCABULARY), band)
    assert not rules.passes(*rules.fertility(same, rules.VOCABULARY), band)


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_labelled_junk_is_rejected(spark, vocabulary):
    """Of documents that pass the base rules, with each of two vocabularies; the bounds were set on even ids."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.where("n_chars < 20000 and doc_id % 2 = 1").join(labels.where("quality = 0 or doc_id % 5 = 0").select("doc_id", "quality").distinct(), "doc_id").collect()
    kept = {0: [], 1: []}
    for r in rows:
        if not brute.base_counts(r.text)[5]:
            band = rules.SCRIPTS[rules.script_of(r.text)][1]
            kept[r.quality].append(rules.passes(*rules.fertility(r.text, f"/opt/tokenizers/{vocabulary}.tiktoken"), band))
    assert len(kept[0]) > 50 and len(kept[1]) > 200
    assert np.mean(kept[0]) < 0.4 and np.mean(kept[1]) > 0.99


def passages():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    shared = [[word() for _ in range(60)] for _ in range(3)]
    texts = list(ODD)
    for _ in range(120):
        w = [word() for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.6:
            s = rng.choice(shared)
            a = rng.randrange(40)
            at = rng.randrange(len(w))
            w[at:at] = s[a : a + rng.randrange(8, 40)]
        texts.append(rng.choice(" \n\t") .join(w))
    return texts + texts[40:60] + ["same words " * 30] * 5


@pytest.mark.parametrize("part_rows, fingerprint", [(substrings.PART_ROWS, 32), (300, 32), (300, 8)])
def test_substrings(spark, part_rows, fingerprint):
    """Also with fingerprints of so few bits that most of them collide: they cost work, not results."""
    texts = passages()
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    expected = brute.substrings(list(enumerate(texts)))
    got = {r.doc_id: r for r in substrings.digests(docs, part_rows=part_rows, fingerprint=fingerprint).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: x[:3] for i, x in expected.items()}
    assert {i: [(p.start, p.words) for p in r.passages] for i, r in got.items()} == brute.maximal_repeats(list(enumerate(texts)))
    if fingerprint == 32:
        cut = {r.doc_id: r for r in substrings.deduplicated(docs, part_rows=part_rows).collect()}
        assert {i: brute.words(r.text) for i, r in cut.items()} == {i: x[3].split(" ") if x[3] else [] for i, x in expected.items() if not x[1] or x[1] < x[0]}
        assert all(cut[i].text == texts[i] and cut[i].chunk == "c" for i, x in expected.items() if not x[1])


def test_words_that_share_a_hash(spark):
    """Words go by their bytes, whatever their hashes say."""
    w = Words(pa.array(["alpha beta alpha", None, "gamma beta " + "long" * 50 + "x", "long" * 50 + "y " + "long" * 50 + "x"]))
    at = np.arange(len(w))
    spelt = [w.raw[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]
    for hashes in (w.hashes(), np.zeros(len(w), np.uint64), w.hashes() % np.uint64(2)):
        number, place = w.numbered(at, hashes)
        assert [spelt[place[k]] for k in number] == spelt and len(place) == len(set(spelt))
    assert all(w.same(np.array([i]), np.array([j]))[0] == (spelt[i] == spelt[j]) for i in at for j in at)


def test_tree_of_words():
    """Suffixes come in order of their words, and nodes are the classes of equal beginnings."""
    rng = np.random.default_rng(2)
    labels = rng.integers(1, 3, (300, 5)).astype(np.int64)
    tree = substrings.Tree.of(labels)
    rows = [tuple(r) for r in labels.tolist()]
    assert [rows[k] for k in tree.order] == sorted(rows)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))
    assert tree.common.tolist() == [common(rows[a], rows[b]) for a, b in zip(tree.order, tree.order[1:], strict=False)]
    for depth in range(1, 6):
        begin, node = tree.nodes(depth)
        heads = [rows[k][:depth] for k in tree.order]
        assert len(begin) == len(set(heads)) and all((node[i] == node[j]) == (heads[i] == heads[j]) for i in range(0, 300, 17) for j in range(0, 300, 13))


def test_substrings_of_odd_tables(spark):
    long = " ".join(f"w{k}" for k in range(20))
    same = spark.createDataFrame([(7, long), (7, long), (None, long), (3, "q " + long)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in substrings.digests(same).collect())
    assert got == [(-1, 20), (3, 0), (7, 20), (7, 20)]
    alone = spark.createDataFrame([(7, long), (7, long), (None, long)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substrings.digests(alone).collect()) == [(-1, 20), (7, 0), (7, 0)]
    assert substrings.digests(same.limit(0)).count() == 0


def test_chunks_do_not_hang_on_arrival(spark):
    """Null and repeated ids on different texts: any order of rows sends the same suffixes, and no chunk holds them all."""
    texts = [" ".join(f"t{k}x{j}" for j in range(20)) for k in range(40)]
    rows = [(None if k % 2 else 7, t) for k, t in enumerate(texts)]
    plan = substrings.Plan(13, 3, 24, [np.full(1 << substrings.BITS, -1)] * len(substrings.PREFIXES))
    sent = []
    for came in (rows, rows[::-1]):
        table = pa.table({"doc_id": pa.array([i for i, _ in came], pa.int64()), "text": pa.array([t for _, t in came])})
        chunk = substrings._Chunk(table, plan)
        sent.append((chunk.asked.tolist(), chunk.doc.tolist(), [table.column("text")[int(k)].as_py() for k in chunk.order]))
    assert sent[0] == sent[1]
    chunks = substrings._dealt(spark.createDataFrame(rows, "doc_id long, text string"), 24).groupBy("doc_id").agg(F.countDistinct(substrings.CHUNK)).collect()
    assert min(r[1] for r in chunks) > 5


def test_parts_split_frequent_prefixes(spark):
    texts = [f"the {k} " + " ".join(f"v{k}x{j}" for j in range(14)) for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    p = substrings.plan(docs, part_rows=100)
    assert p.parts > 5 and (p.tables[0] == -1).sum() > 0


def near_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = list(ODD)
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(20, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            w = list(base)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    return texts + texts[12:20] + ["one two"] * 3


def test_near_classes(spark):
    texts = near_texts()
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.classes(docs).collect()}
    expected = brute.near_classes(list(enumerate(texts)))
    assert {i: c for i, (c, _) in got.items()} == expected
    assert {r.doc_id for r in neardup.kept(docs).collect()} == set(expected.values())
    assert neardup.classes(docs.limit(0)).count() == 0


def test_near_classes_in_blocks(spark):
    """A hot group in many blocks, connected through a few texts."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(100)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs, block=16).collect()}
    assert got == brute.near_classes(list(enumerate(texts)))


def test_near_copies_with_repeated_passages(spark):
    """Copies whose shingle sets are near and whose counts are far."""
    rng = random.Random(11)
    texts = []
    for times in (0, 1, 3, 10, 20, 40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(base), " ".join(base[:125] + base[100:125] * times + base[125:]), " ".join(base + base[:40] * (times // 2))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == brute.near_classes(list(enumerate(texts)))
    assert len(set(got.values())) == 6


def test_shared_shingles():
    rng = np.random.default_rng(5)
    sets = [(np.unique(rng.integers(0, 60, 40)).astype(np.uint32), None) for _ in range(12)]
    sets = [(h, rng.integers(1, 3, len(h)).astype(np.uint32)) for h, _ in sets]
    shared = neardup.Shared(sets)
    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets):
            both = len(set(a.tolist()) & set(b.tolist()))
            assert shared.row(i)[j] == both
            larger = max(both / (len(a) + len(b) - both), neardup.probability_jaccard((a, x), (b, y)))
            assert shared.reaches(i, j, larger - 1e-9) and not shared.reaches(i, j, larger + 1e-9)


def test_families_under_one_hub(spark):
    """A large family and strangers that share bands with it meet, but its own blocks don't."""
    star = spark.createDataFrame([(k, 0) for k in range(1, 60)] + [(100, 0), (101, 0), (101, 5)], "a long, b long")
    families = spark.createDataFrame([(k, 0) for k in range(60)], "node long, root long")
    cells = neardup._left(star, families, block=16).collect()
    own = {r.node: r.own for r in cells}
    assert set(own) == {*range(60), 100, 101} and own[100] == own[101] == 0 and {own[k] for k in range(60)} == {1, 2, 3, 4}
    met = {(r.low, r.high) for r in cells}
    assert met == {(0, 0), (0, 1), (0, 2), (0, 3), (0, 4)} and len(cells) == 60 + 2 * 5


def test_hot_keys_are_met_by_salt(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("u"), F.col("id").alias("v"))
    got = {(r.u, r.v): r.m for r in with_figure(rows, "u", "v", F.min("v"), F.min("__p"), "m").collect()}
    assert len(got) == 2000 and all(m == (0 if u == 7 else v) for (u, v), m in got.items())
    named = with_lookup(rows, "u", "v", spark.createDataFrame([(7, "hot")], "k long, name string"), "k")
    assert sorted((r.name or "", r["count"]) for r in named.groupBy("name").count().collect()) == [("", 500), ("hot", 1500)]
    hit = sifted(rows, ["u"], spark.createDataFrame([(7,)], "k long"), ["k"], 1).groupBy("__hit").count().collect()
    assert {r["__hit"]: r["count"] for r in hit}[True] >= 1500


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "other words entirely here now"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.class_size) for r in neardup.classes(docs).collect())
    assert got == [(-1, -1, 1), (-1, -1, 1), (-1, 4, 3), (4, 4, 3), (4, 4, 3)]


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**32, 300).astype(np.uint64)
    a, b = (keys[:240], rng.integers(1, 5, 240)), (keys[60:], rng.integers(1, 5, 240))
    b[1][:180] = a[1][60:]
    rows = np.repeat([0, 1], 240)
    s = neardup.signatures(rows, np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), 2, m=2048)
    x, y = ((np.sort(k).astype(np.uint32), c[np.argsort(k)]) for k, c in (a, b))
    exact = neardup.probability_jaccard(x, y)
    plain = {int(k): int(c) for k, c in zip(*a, strict=True)}, {int(k): int(c) for k, c in zip(*b, strict=True)}
    both = set(plain[0]) & set(plain[1])
    slow = sum(1 / sum(max(plain[0].get(e, 0) / plain[0][d], plain[1].get(e, 0) / plain[1][d]) for e in set(plain[0]) | set(plain[1])) for d in both)
    assert abs(exact - slow) < 1e-9 and abs((s[0] == s[1]).mean() - exact) < 0.05

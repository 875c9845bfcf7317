"""Operators on records: packing, chat, search, archives, mixing."""

import gzip
import hashlib
import io
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from redactory.llm import chat, mixing, packing, topk, warc

from . import brute

DIR = "/root/testdata/sf0.001"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.sampled_from([(64,), (16, 64), (8, 16, 32, 64)]))
def test_pack(sizes, lengths):
    sizes = np.array(sizes, np.int64)
    b, place, offset, capacity = packing.pack(sizes, lengths, overhead=2)
    for k in range(len(capacity)):
        own = np.flatnonzero(b == k)
        order = own[np.argsort(place[own])]
        assert list(place[order]) == list(range(len(own))) and list(offset[order]) == [0, *np.cumsum(sizes[order])[:-1]]
        assert capacity[k] == min(x for x in lengths if x >= sizes[own].sum())
    assert (b.tolist(), capacity.tolist()) == brute.pack(sizes.tolist(), lengths, 2)


def test_joint_lengths_cost_less_than_one():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 5000, 400)
    cost = lambda lengths: packing.pack(sizes, lengths)[3].sum()
    assert cost((512, 1024, 2048, 4096, 8192)) <= cost((8192,)) and cost((512, 1024, 2048, 4096, 8192)) < 1.03 * sizes.sum()


def test_packed(spark):
    texts = [None, "", " ", "a", "w " * 20_000, "b c", "b c"] + ["x " * k for k in range(1, 300, 7)]
    rows = [(i, t, 5, "s") for i, t in enumerate(texts)] + [(5, "b c", 5, "s"), (None, "d e", 5, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin int, shard string")
    placed = packing.packed(docs, shard_words=500)
    got = placed.collect()
    assert sum(r.n_words for r in got) == sum(len(brute.words(t)) for _, t, _, _ in rows)
    assert len({r.shard for r in got}) > 3 and {r.doc_id for r in got} == {i for i, t, _, _ in rows if brute.words(t)}
    bins = {}
    for r in sorted(got, key=lambda r: (r.shard, r.bin, r.place)):
        assert r.offset == bins.get((r.shard, r.bin), 0)
        bins[r.shard, r.bin] = r.offset + r.n_words
        assert r.offset + r.n_words <= r.capacity
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    made = packing.sequences(unique, packing.packed(unique)).collect()
    assert sum(len(r.words) for r in made) == sum(len(brute.words(t)) for i, t in enumerate(texts)) and all(len(r.words) <= r.capacity for r in made)
    assert packing.packed(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool\nx", "[ROLE]"]), st.text("<s>/[INST] \\.nROLE\n", max_size=30)), max_size=6))
def test_template_round_trip(turns):
    text = "<s>" + "".join(chat.render(r, t)[0] for r, t in turns)
    assert chat.parse(text) == turns
    for r, t in turns:
        piece, a, b = chat.render(r, t)
        assert chat.unescape(piece[a:b]) == t and not any(c in piece[a:b] for c in chat.CONTROL)


def test_examples(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", "yo"), (1, 2, "user", None), (1, 3, "assistant", "</s>"), (1, 4, "user", "bye"), (2, 0, None, "q"), (None, 0, "assistant", "z")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string")
    made = chat.examples(turns)
    got = {(r.conv_id, r.example): (r.text, r.text[r.target_start : r.target_end] if r.target_start is not None else None) for r in made.collect()}
    assert got[1, 0] == ("<s>[INST] yo [/INST] hi</s>", "hi")
    assert got[1, 1] == ("<s>[INST] yo [/INST] hi</s>[INST]  [/INST] <\\./s></s>", "<\\./s>")
    assert got[1, 2] == (got[1, 1][0] + "[INST] bye [/INST]", None)
    assert got[2, 0] == ("<s>[ROLE] \nq [/ROLE]", None) and got[None, 0] == ("<s> z</s>", "z")
    d = {r.conv_id: r for r in chat.digests(made).collect()}
    assert d[1].loss_sha256 == hashlib.sha256(b"hi</s>").hexdigest() and d[1].loss_chars == 6 and d[1].n_turns == 5
    assert d[1].turns_sha256 == hashlib.sha256(b"user\nyo\nassistant\nhi\nuser\n\nassistant\n</s>\nuser\nbye\n").hexdigest()
    assert d[1].formatted_chars == sum(len(t) for (c, _), (t, _) in got.items() if c == 1)
    assert chat.digests(chat.examples(turns.limit(0))).count() == 0
    # Written and read again in other splits and another order, the digests are the same; a context that was changed is seen.
    again = spark.createDataFrame(sorted(made.collect(), key=lambda r: r.text, reverse=True), made.schema).repartition(5)
    assert {r.conv_id: r for r in chat.digests(again).collect()} == d
    wrong = F.when((F.col("conv_id") == 1) & (F.col("example") == 0), F.replace("text", F.lit("yo"), F.lit("no"))).otherwise(F.col("text"))
    broken = {r.conv_id: r.turns_sha256 for r in chat.digests(made.withColumn("text", wrong)).collect()}
    assert broken[1] is None and broken[2] == d[2].turns_sha256


@pytest.mark.parametrize("shards", [40, None])
def test_search(spark, shards):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], "x") for i in range(150)]
    rows += [(i + 150, rows[i % 3][1], "x") for i in range(20)]  # ties
    rows += [(900, None, "x"), (901, [1.0, None, 0, 0, 0, 0], "x"), (902, [float("nan")] * 6, "x"), (903, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x"), (950, [1.0, 2.0], "x"), (1000, [0.5, 0.5], "x")]
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], s) for i, v, s in rows], "vec_id long, embedding array<float>, shard string")
    whole = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    expected = brute.top_k(list(whole.items()), [(i, v) for i, v in whole.items() if i % 50 == 0])
    got = {}
    for r in topk.search(df, df.where("vec_id % 50 = 0"), shard_rows=shards, cells=16 if shards else None, block_rows=3 if shards else 1000).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == {q: v for q, v in expected.items() if v}
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_kd_tree_prunes():
    rng = np.random.default_rng(1)
    points = rng.integers(-256, 256, (4000, 2)).astype(float)
    tree = topk.KDTree(np.arange(4000), points, leaf=16)
    q = np.array([100.0, -30.0])
    ids, scores = tree.search(q, tree.bounds(q[None])[0], -1, 5, float("-inf"))
    order = np.lexsort((np.arange(4000), -(points @ q)))[:5]
    assert list(ids) == list(order) and list(scores) == list((points @ q)[order])
    assert (tree.bounds(q[None])[0] >= scores[-1]).sum() < len(tree.child) / 4
    for k, (a, b) in enumerate(tree.span):
        assert (tree.vectors[a:b] >= tree.low[k]).all() and (tree.vectors[a:b] <= tree.high[k]).all()


def test_archives(spark, tmp_path):
    same = "<p>same</p>" * 20
    rows = [(5, "u5", same), (3, "u3", same), (9, None, same), (3, "u3", same), (7, "u7", "tiny"), (8, "u8", "tiny"), (1, "u\r\n1", None), (2, "u2", "WARC/1.1\r\n\r\n" * 40 + "é"), (None, "u", "null id")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    one = lambda i, x, kind="response", to=None: (i, len(x.encode()), sha(x), kind, to)
    assert got == sorted([one(5, same, "revisit", 3), one(3, same), one(3, same), one(9, same, "revisit", 3), one(7, "tiny"), one(8, "tiny"), one(1, ""), one(2, rows[7][2]), one(-1, "null id")])
    assert warc.round_trip(pages.limit(0)).count() == 0

    path = str(tmp_path / "arc")
    warc.write_pages(pages, path)
    read = lambda: spark.read.format("warc").load(path)
    assert read().where("type = 'revisit'").count() == 2 and read().where("type = 'response' and payload_digest in ('%s')" % sha("tiny")).count() == 2
    assert "payload" not in spark.read.format("warc").option("payload", "false").load(path).columns
    (tmp_path / "arc" / "part-stray.warc").write_bytes(b"not committed")
    assert read().count() == len(rows)

    # Archives are cut at marks, also where a payload looks like records, and two commits are both seen.
    (marked := tmp_path / "marked").mkdir()
    register = lambda: warc.archive_pages(pages).coalesce(1).write.format("warc").mode("append").option("mark_bytes", "600").option("packed", "false").save(str(marked))
    register()
    register()
    cut = spark.read.format("warc").option("partition_bytes", "700").load(str(marked))
    assert cut.rdd.getNumPartitions() > 4 and cut.count() == 2 * len(rows) and sorted(r[0] for r in cut.select("record_id").collect())[::2] == sorted(r[0] for r in read().select("record_id").collect())

    # Archives of others: packed by record, folded headers, plain blocks.
    block = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nX-Note: a\r\n b\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "own.warc.gz").write_bytes(gzip.compress(block) + gzip.compress(block.replace(b"resource", b"metadata")))
    own = lambda: spark.read.format("warc").load(str(tmp_path / "own.warc.gz"))
    assert [(r.type, r.record_id, bytes(r.payload)) for r in own().where("type = 'resource'").collect()] == [("resource", "urn:x", b"hello")] and own().count() == 2


def test_unwanted_payloads_are_not_read():
    """The reader seeks past blocks whose headers fail the pushed predicates."""
    body = b"x" * 1_000_000
    row = {"type": "response", "record_id": "r", "target_uri": None, "refers_to": None, "payload_digest": "d", "payload": body}
    raw = b"".join(warc.record(row | {"record_id": f"r{k}"}, "2000-01-01T00:00:00Z", packed=False) for k in range(20))

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    from pyspark.sql.types import StructType

    reader = warc.WarcReader({"path": "/x"}, StructType.fromDDL(warc.SCHEMA))
    from pyspark.sql.datasource import EqualTo, IsNotNull

    rest = list(reader.pushFilters([EqualTo(("record_id",), "r7"), IsNotNull(("payload",))]))
    assert len(rest) == 1
    file = Counted(raw)
    got = list(reader.records(file, packed=False))
    assert [r[0] for r in got] == ["r7"] and got[0][-1] == body and file.taken < len(raw) / 3


def _mix(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    c = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    c.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM documents")
    expected = c.execute(mixing.SQL).fetchall()
    got = [tuple(r) for r in mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(expected, key=key)
    return docs, got


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 30), rng.choice(["a", "a", "a", "a", "b", "c", "d", None, "é"]), "x") for i in range(400)]
    docs, got = _mix(spark, rows)
    by = {}
    for (_, _, source, _), r in zip(sorted(rows), sorted(got), strict=True):
        assert r[4] <= 3 * r[1] and r[4] % max(1, r[1]) == 0
        by.setdefault(source, [r[3], 0])[1] += r[4]
    assert all(abs(taken - target) <= 60 for target, taken in by.values())
    assert abs(sum(t for _, t in by.values()) - sum(r[1] for r in got)) <= 60
    taken = {r[0]: r[4] // r[1] for r in got if r[1]}
    real = mixing.mixed(docs)
    counts = {r.doc_id: r["count"] for r in real.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n} and real.columns == docs.columns


def test_mix_of_odd_tables(spark):
    _mix(spark, [(1, None, "a", "x"), (2, "", "b", "x")])
    _mix(spark, [(1, "a b", None, "x"), (1, "a b", None, "x"), (None, "c", "z", "x"), (5, "d " * 50, "z", "x")])
    _, got = _mix(spark, [(None, "w " * (k % 30 + 1), "ab"[k % 2], "x") for k in range(300)])
    assert len(got) == 300
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mix_has_no_python(spark):
    plan = mixing.plan(spark.read.parquet(f"{DIR}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""Near-duplicate documents by ProbMinHash: signatures, banding, verification, components.

A text is a weighted set: its shingles of five words with their counts. In ProbMinHash every shingle sends arrivals of a
Poisson process of rate equal to its weight to random registers; a register keeps the shingle whose arrival came first,
and a text stops early, once no shingle's next arrival can come before its slowest register. Two texts agree in a
register with the probability Jaccard similarity of their weighted sets.

A text in which shingles repeat has a second signature with all weights 1, whose registers agree with the Jaccard
similarity of shingle sets; without repeats the two are one. So a pair is found by either kind of similarity.

1. Exact copies fold into one text by their SHA-256. 2. Signatures of 252 registers are cut into 42 bands of 6, those of
both signatures under the same keys; a pair of similarity 0.8 of either kind shares a band with chance over 0.99999.
3. Every text hangs on the smallest text of each of its bands, its hubs. 4. Each text is verified against its hubs, on
whole shingle sets; verified links join texts to families. 5. Where texts of several families hang on hubs of one, they go
on: they are dealt to blocks of ``block``, a large family to blocks of its own, and pairs of blocks meet in tasks of their
own, but never two blocks of one family. So a family of n copies of one text costs n comparisons, a task is bounded
whatever a hub's size, and still every pair of texts that shares a band and that nothing has joined yet is considered, by
falling register agreement, the larger of both kinds. 6. Verified links of both rounds form the classes.

A pair is linked if its similarity, Jaccard on shingle sets or probability Jaccard on counts, is ``threshold`` or more.
Whole texts are read once to sign them; a second scan keeps those that a bitmap of the candidates lets through, and only
their signatures and shingle sets are shuffled. Figures of a hub, a text or a class are met by key and salt, so that one
family that most rows belong to is no single task's. Intermediate tables go when the classes are written.

Defined results: null texts and texts without words are classes of their own; texts of one to four words are one
shingle of all their words; exact copies share a class if they have a word; repeated rows are copies of each other;
a class's id is its smallest doc_id (null only if all are null); texts whose smallest doc_id is the same share a class;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .session import Scratch, arrow_rows, frugal, settled, small_plans
from .sieve import SALTS, sifted, with_figure, with_lookup
from .words import Words, mix, slices

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
BLOCK = 512
#: Texts that a verification group holds, roughly; small clusters share a group.
GROUP = 512
#: Numbers of texts whose copies all lack a doc_id begin here.
UNNUMBERED = 1 << 62
SIGNED = "doc_id long, copies binary, bands array<long>"
SETS = ("signature", "plain", "shingles", "counts")
PREPARED = "doc_id long, copies binary, signature binary, plain binary, shingles binary, counts binary"
#: Pairs under this register agreement of both kinds are not verified: 0.8 less over four standard deviations of an estimate from 252 registers.
AGREE = 0.68
_G = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 32-bit hash and count of every distinct shingle, by row and hash."""
    w = Words(texts)
    hashes = w.hashes()
    keys, at = w.windows(hashes, k)
    rows = w.rows()[at]
    for n in range(1, k):  # shorter texts are one shingle
        short = np.flatnonzero(w.counts == n)
        if len(short):
            total = np.full(len(short), np.uint64(n))
            for j in range(n):
                total = mix(total + hashes[w.first[short] + j])
            keys, rows = np.concatenate([keys, total]), np.concatenate([rows, short])
    packed = np.sort((rows.astype(np.uint64) << np.uint64(32)) | (keys >> np.uint64(32)))
    begin = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, np.int64)
    found = packed[begin]
    return (found >> np.uint64(32)).astype(np.int64), found & np.uint64(2**32 - 1), np.diff(np.append(begin, len(packed)))


def signatures(rows: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers, each 24 bits of the shingle that came first.

    Arrival time (high bits) and shingle (low bits) are one number, so that one minimum keeps both.
    """
    best = np.full(n * m, np.uint64(2**64 - 1))
    time, state, row, rate = np.zeros(len(keys)), mix(keys + _G), rows, weights.astype(np.float64)
    tag = mix(keys) & np.uint64(0xFFFFFF)
    while len(row):
        state = mix(state + _G)
        time = time - np.log(((state >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate
        state = mix(state + _G)
        key = (time.view(np.uint64) << np.uint64(1)) & np.uint64(0xFFFFFFFFFF000000) | tag  # a time has no sign
        np.minimum.at(best, row * m + (state % np.uint64(m)).astype(np.int64), key)
        go = np.flatnonzero(key <= best.reshape(n, m).max(1)[row])
        time, state, row, tag, rate = time[go], state[go], row[go], tag[go], rate[go]
    return best.reshape(n, m) & np.uint64(0xFFFFFF)


def plain(rows: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in which a shingle repeats, and their registers with all weights 1; other rows have those already."""
    some = np.unique(rows[counts > 1])
    own = np.isin(rows, some)
    return some, signatures(np.searchsorted(some, rows[own]), keys[own], np.ones(int(own.sum()), np.int64), len(some))


def bands(signature: np.ndarray) -> np.ndarray:
    """Keys of each row's bands."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _G, parts.shape[:2]).copy()
    for j in range(ROWS):
        out = mix(out + parts[:, :, j])
    return out.view(np.int64)


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bands of each row; rows without words have no copies and no bands."""
    for batch in batches:
        for part in slices(batch, most=2 << 20):
            n = part.num_rows
            rows, keys, counts = shingles(part.column("text"))
            some = np.unique(rows)
            heavy, second = plain(rows, keys, counts)
            key, of = np.concatenate([bands(signatures(rows, keys, counts, n)[some]), bands(second)]), np.concatenate([some, heavy])
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(n), "right") * BANDS
            band = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(key[order].ravel()))
            worded = pa.array(np.arange(n), mask=~np.isin(np.arange(n), some))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("copies").take(worded), band], ["doc_id", "copies", "bands"])


def _prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signature and shingle set of each row; counts and the signature without them only where one is over 1."""
    for batch in batches:
        for part in slices(batch, most=2 << 20):
            rows, keys, counts = shingles(part.column("text"))
            signature = (signatures(rows, keys, counts, part.num_rows) & np.uint64(0xFFFF)).astype(np.uint16)
            second = [b""] * part.num_rows
            for k, x in zip(*plain(rows, keys, counts), strict=True):
                second[k] = (x & np.uint64(0xFFFF)).astype(np.uint16).tobytes()
            at = np.searchsorted(rows, np.arange(part.num_rows + 1))
            keys, counts = keys.astype(np.uint32), np.minimum(counts, 2**31).astype(np.uint32)
            spans = list(zip(at[:-1], at[1:], strict=True))
            made = [[x.tobytes() for x in signature], second, [keys[a:b].tobytes() for a, b in spans], [counts[a:b].tobytes() if b > a and counts[a:b].max() > 1 else b"" for a, b in spans]]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("copies"), *(pa.array(x, pa.binary()) for x in made)], ["doc_id", "copies", *SETS])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): the smallest node connected with each node of the edges (a, b), by rounds of large and small stars over the edges.

    Large star: each node's larger neighbours go to the smallest node near it. Small star: its smaller ones and itself do.
    Rounds grow with the logarithm of a chain's length; each costs one look at whether all edges lead to a root.
    """
    edges = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    with small_plans(scratch.spark):
        edges = _stars(edges, scratch, name)
    settled(scratch.spark)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _stars(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Edges (u, v) as a star forest: each node that is no root hangs on its root."""

    def least(rows: DataFrame) -> DataFrame:
        return with_figure(rows, "u", "v", F.min("v"), F.min("__p"), "m")

    while True:
        both = edges.union(edges.select("v", "u"))
        large = least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        pair = lambda x: F.struct(F.col(x).alias("u"), F.col("m").alias("v"))
        small = least(large).select(F.explode(F.array(pair("v"), pair("u"))).alias("e")).select("e.*").where("u <> v").distinct()
        older, edges = edges, scratch.write(small, name)
        scratch.drop(older)
        # Done when every node hangs on one root and no root hangs on another.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)).distinct())
        if not ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("low")).where("n > 1 or (n = 1 and low = 0)").limit(1).count():
            return edges


class Shared:
    """How many shingles texts share: of one text with all others at a time, by lists of the texts that hold each shingle."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]]):
        self.sets, self.sizes = sets, np.array([len(h) for h, _ in sets])
        self.weighted = np.array([bool(len(c)) and int(c.max()) > 1 for _, c in sets])
        held, of = np.concatenate([h for h, _ in sets]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(held, kind="stable")
        self.held, self.of, self.rows = held[order], of[order], {}

    def row(self, i: int) -> np.ndarray:
        if i not in self.rows:
            a, b = (np.searchsorted(self.held, self.sets[i][0], side) for side in ("left", "right"))
            size = b - a
            at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
            self.rows[i] = np.bincount(self.of[at], minlength=len(self.sets))
        return self.rows[i]

    def reaches(self, i: int, j: int, threshold: float) -> bool:
        """Whether the larger of Jaccard on sets and probability Jaccard on counts is threshold or more."""
        both = int(self.row(i)[j])
        if both and both >= threshold * (int(self.sizes[i]) + int(self.sizes[j]) - both):
            return True
        return bool(both and (self.weighted[i] or self.weighted[j])) and probability_jaccard(self.sets[i], self.sets[j]) >= threshold


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over shared shingles of 1 / sum over all of max(weight ratios); (sorted hashes, counts) each."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    ratios = y / x  # shingles of a alone have ratio 0, of b alone infinity
    order = np.argsort(ratios)
    x, y, ratios = x[order], y[order], ratios[order]
    total_a, total_b = float(a[1].sum()), float(b[1].sum())
    # sum over all d of max(a_d / x_k, b_d / y_k): those of smaller ratio take a's side, those of larger b's
    upto = np.cumsum(x) + (total_a - x.sum())
    beyond = y.sum() - np.cumsum(y) + (total_b - y.sum())
    return float((1 / (upto / x + beyond / y)).sum())


def _links(nodes: np.ndarray, signature: np.ndarray, second: np.ndarray | None, sets: list, first: int | None, threshold: float) -> list[tuple[int, int]]:
    """Verified links that connect texts with each other, or the first so many with the rest; second: the signatures without counts, if any differ."""
    n = len(nodes)
    a, b, agree = [], [], []
    for i in range(n - 1 if first is None else first):
        begin = i + 1 if first is None else first
        share = (signature[begin:] == signature[i]).mean(1)
        if second is not None:
            share = np.maximum(share, (second[begin:] == second[i]).mean(1))
        got = np.flatnonzero(share >= AGREE)
        a.append(np.full(len(got), i))
        b.append(got + begin)
        agree.append(share[got])
    if not a:
        return []
    a, b, agree = np.concatenate(a), np.concatenate(b), np.concatenate(agree)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, shared = [], None
    for k in np.argsort(-agree, kind="stable"):
        i, j = find(int(a[k])), find(int(b[k]))
        if i != j:
            shared = shared or Shared(sets)
            if shared.reaches(int(a[k]), int(b[k]), threshold):
                parent[i] = j
                out.append((int(nodes[a[k]]), int(nodes[b[k]])))
    return out


def _set(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(hashes, np.uint32)
    return h, np.frombuffer(counts, np.uint32) if counts else np.ones(len(h), np.uint32)


def _verify(threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by([("root", "ascending"), ("low", "ascending"), ("high", "ascending")])
        root, low, high, own, node = (table.column(c).to_numpy() for c in ("root", "low", "high", "own", "node"))
        columns = [table.column(c).to_pylist() for c in ("signature", "plain", "shingles", "counts")]
        new = np.flatnonzero(np.append(True, (root[1:] != root[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        out = []
        for start, end in zip(new, np.append(new[1:], len(root)), strict=True):
            at = np.arange(start, end)
            first = None
            if low[start] != high[start]:
                first = int((own[at] == low[start]).sum())
                at = at[np.argsort(own[at] != low[start], kind="stable")]
            if len(at) > 1:
                signature = np.stack([np.frombuffer(columns[0][i], np.uint16) for i in at])
                second = np.stack([np.frombuffer(columns[1][i] or columns[0][i], np.uint16) for i in at]) if any(columns[1][i] for i in at) else None
                out += _links(node[at], signature, second, [_set(columns[2][i], columns[3][i]) for i in at], first, threshold)
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return verify


def _met(cells: DataFrame, n: int, threshold: float) -> DataFrame:
    """Verified links (a, b) of texts that are dealt to cells (root, low, high) and have n copies in all."""
    groups = max(1, -(-n // GROUP))
    return cells.groupBy(F.pmod(F.xxhash64("root", "low", "high"), F.lit(groups)).alias("g")).applyInArrow(frugal(_verify(threshold)), "a long, b long")


def _with_hubs(star: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Texts beside their hubs, with their sets: cells of one hub and ``block`` texts at most, roughly."""
    counted = with_figure(star, "b", "a", F.count("*"), F.sum("__p"), "degree")
    dealt = counted.select("a", "b", (2 * F.pmod(F.xxhash64("a", F.lit(3)), F.ceil(F.col("degree") / block))).cast("int").alias("low"))
    leaves = dealt.select(F.col("a").alias("node"), (F.col("low") + 1).alias("own"), F.col("b").alias("root"), "low", (F.col("low") + 1).alias("high"))
    hubs = dealt.select("b", "low").distinct().select(F.col("b").alias("node"), F.col("low").alias("own"), F.col("b").alias("root"), "low", (F.col("low") + 1).alias("high"))
    return leaves.union(hubs).join(sets.hint("merge"), "node")


def _left(star: DataFrame, families: DataFrame, block: int) -> DataFrame:
    """The texts that hang on hubs of one family, if they are of several, dealt to the pairs of blocks that they belong to: node, own, root, low, high.

    Texts that share a band hang on the same hub, so every pair that shares one and that no link has joined meets here.
    """
    family = families.select("node", F.col("root").alias("f"))
    hung = with_lookup(star, "b", "a", family, "node").select("a", F.coalesce("f", "b").alias("root"))
    hung = hung.union(star.select("b").distinct().join(family.hint("merge"), F.col("b") == F.col("node"), "left").select("b", F.coalesce("f", "b"))).distinct()
    member = hung.join(family.hint("merge"), F.col("a") == F.col("node"), "left").select(F.col("a").alias("node"), "root", F.coalesce("f", "a").alias("family"))
    large = F.col("n") >= block / 2
    kin = member.groupBy("root", "family").agg(F.count("*").alias("n")).withColumn("large", large)
    kin = kin.withColumn("blocks", F.when(large, F.ceil(F.col("n") / block)).otherwise(0)).withColumn("few", F.when(large, 0).otherwise(F.col("n")))
    kin = with_figure(kin, "root", "family", F.struct(F.count("*").alias("a"), F.sum("few").alias("b"), F.sum("blocks").alias("c")), F.struct(F.sum("__p.a").alias("families"), F.sum("__p.b").alias("rest"), F.sum("__p.c").alias("more")), "all")
    kin = kin.select("root", "family", "large", "blocks", "all.*").where("families > 1").withColumn("shared", F.ceil(F.col("rest") / block))
    # Blocks 0 to shared - 1 hold the small families; large ones, at most one for block / 2 texts, have blocks of their own behind them.
    ahead = F.sum("blocks").over(W.partitionBy("root").orderBy("family")) - F.col("blocks")
    total = (F.col("shared") + F.col("more")).cast("int").alias("total")
    few = kin.where("not large").select("root", "family", "large", F.lit(0).alias("first"), total, F.col("shared").cast("int").alias("blocks"))
    spans = few.union(kin.where("large").select("root", "family", "large", (F.col("shared") + ahead).cast("int"), total, F.col("blocks").cast("int")))
    told = member.withColumn("s", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    told = told.join(told.select("root", "family", "s").distinct().join(spans.hint("merge"), ["root", "family"]).hint("merge"), ["root", "family", "s"])
    placed = told.withColumn("own", F.col("first") + F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    met = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda o: ~F.col("large") | (o < F.col("first")) | (o >= F.col("first") + F.col("blocks")))
    pairs = F.transform(met, lambda o: F.struct(F.least(o, F.col("own")).alias("low"), F.greatest(o, F.col("own")).alias("high")))
    return placed.select("node", "own", "root", F.explode(pairs).alias("m")).select("node", "own", "root", "m.*")


def classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id and class_size, one row per document."""
    arrow_rows(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("copies"))
    rows = scratch.write(docs.mapInArrow(frugal(_sign), SIGNED), "signed")

    # A text's number is the smallest id of its copies; those without any are numbered behind all ids.
    worded = rows.where("copies is not null").withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = scratch.write(worded.groupBy("copies", "s").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "parts")
    texts = parts.groupBy("copies").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
    texts = scratch.write(texts.withColumn("node", F.coalesce("first_id", F.lit(UNNUMBERED) + F.pmod(F.xxhash64("copies"), F.lit(UNNUMBERED)))), "texts")

    settled(scratch.spark)
    # Hubs: the smallest text of each band that several texts have. Bands of one text don't leave their scan.
    first = texts.select(F.col("copies").alias("copy"), "first_id", "node")
    one = rows.join(first.hint("merge"), (rows["copies"] == F.col("copy")) & rows["doc_id"].eqNullSafe(F.col("first_id"))).select("node", "bands")
    keyed = scratch.write(one, "bands").select("node", F.explode("bands").alias("band"))
    settled(scratch.spark)
    hubs = scratch.write(keyed.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").select(F.col("band").alias("key"), "b"), "hubs")
    shared = sifted(keyed, ["band"], hubs, ["key"], hubs.count()).where("__hit").select("node", "band")
    star = scratch.write(shared.join(hubs.hint("merge"), F.col("band") == F.col("key")).where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "star")

    # The signatures and shingle sets of the candidates, from a second scan that lets few others through.
    nodes = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    wanted = scratch.write(nodes.join(texts.hint("merge"), "node").select("node", F.col("copies").alias("copy"), "first_id"), "wanted")
    settled(scratch.spark)
    some = sifted(docs, ["doc_id", "copies"], wanted, ["first_id", "copy"], wanted.count()).where("__hit").select("doc_id", "copies", "text")
    sets = some.mapInArrow(frugal(_prepare), PREPARED).join(wanted.hint("merge"), (F.col("copies") == F.col("copy")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    sets = scratch.write(sets.select("node", *SETS), "sets")
    settled(scratch.spark)

    links = _met(_with_hubs(star, sets, block), 2 * star.count(), threshold)
    families = scratch.write(components(links, scratch, "families"), "families")
    with small_plans(scratch.spark):
        rest = scratch.write(_left(star, families, block), "rest")
    met = rest.count()
    tight = families
    if met:
        more = _met(rest.join(sets.hint("merge"), "node"), met, threshold)
        tight = components(more.union(families.select("node", "root")), scratch, "tight")

    # Classes of texts, and by copies and salt of rows.
    grouped = with_figure(texts.join(tight.hint("merge"), "node"), "root", "node", F.sum("n"), F.sum("__p"), "class_size").select("copies", "root", "class_size")
    known = texts.join(grouped.hint("merge"), "copies", "left").select("copies", F.coalesce("root", "node").alias("root"), F.coalesce("class_size", "n").alias("class_size"))
    known = parts.select("copies", "s").join(known.hint("merge"), "copies")
    named = rows.withColumn("s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).drop("bands").join(known.hint("merge"), ["copies", "s"], "left")
    root = F.when(F.col("root").isNull(), F.col("doc_id")).when(F.col("root") < UNNUMBERED, F.col("root"))
    out = Scratch(docs.sparkSession, "near-classes").write(named.select("doc_id", root.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")), "classes")
    scratch.close()
    return out


def kept(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, that of the smallest id (rows that repeat its id stay with it).

    Only rows that a bitmap of the ids to go lets through are joined; all others pass where they are read.
    """
    by_id = classes(docs, threshold).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays"))
    gone = Scratch(docs.sparkSession, "near-gone").write(by_id.where("not stays").select(F.col("doc_id").alias("__gone_id")), "gone")
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = sifted(docs.withColumn("__id", F.col("doc_id").cast("long")), ["__id"], gone, ["__gone_id"], gone.count())
    stay = rows.where("__hit").join(gone.hint("merge"), F.col("__id").eqNullSafe(F.col("__gone_id")), "left_anti")
    return rows.where("not __hit").select(*names).union(stay.select(*names))

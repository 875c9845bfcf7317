"""Exact substring deduplication by prefix-partitioned suffix trees.

Every position of a text where a window of ``length`` words fits begins a suffix. A suffix goes by a prefix of one, two or
four words: of those that begin inside its window the one of least hash, so that equal windows go by the same prefix, and
neighbours in a text mostly do too and travel together. One pass counts suffixes by their prefixes; a prefix that is too
frequent is lengthened (in the end to the whole window), and the prefixes, now of variable length, are packed into parts
of about ``part_rows`` suffixes that fit in a task's memory.

A suffix that hangs on no deep internal node is a leaf by itself, and most are. So parts first see 32-bit fingerprints of
windows alone and tell which stand in several chunks of texts; a false one costs work but no result. Of those, chunks send
the words: for each part the stretches of text that its suffixes begin in, with a word before and a word behind. The part's
task sorts the suffixes, cut at depth ``length``, by their words, takes the common-prefix lengths of neighbours, and reads
the deep internal nodes, those of depth ``length``, off them: the smallest document below a node, and whether what stands
before or behind its leaves differs. Words are compared as words, nowhere by a hash, so results are exact.

Every leaf of a larger document than its node's smallest is a repeat, and the words its window covers go. Consecutive
repeats whose nodes branch neither to the left nor to the right between them have the same places everywhere: they make
one maximal repeat, and ``passages`` lists these (they may overlap).

Texts are dealt to chunks by a hash of their id and text, and ordered in a chunk by id and, where ids tie, a hash of the
text, so that nothing hangs on the order in which rows arrive. A chunk sends a suffix once however often it holds it, from its
smallest document, packed in one row for each part; a passage that a third of all documents share therefore reaches its
node once a chunk. The node's answer, three bits a suffix, goes back to the chunk.

Defined results: null texts have no words; texts of fewer words than ``length`` lose none; windows are judged on the
input, not on what is left; a null doc_id counts as larger than all others; rows of equal doc_id do not repeat each
other; an empty table gives no rows; other columns are carried along by deduplicated() and ignored by digests().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import arrow_rows, frugal, settled
from .words import _ODD, Words, covered, grouped, mix, slices, sums

LENGTH = 13
PART_ROWS, CHUNK_BYTES, LEAST_CHUNKS = 2_000_000, 8 << 20, 24
#: Bins that prefixes of each length are counted in, and those lengths.
BITS, PREFIXES = 14, (1, 2, 4)
#: Bits of the fingerprints that tell which windows may repeat.
FINGERPRINT = 32
DIGESTS = "doc_id long, n_words long, n_removed long, kept_sha256 string, passages array<struct<start:int,words:int>>"
CHUNK = "__chunk"  # no column of the input is called this
LAST = np.iinfo(np.int64).max


def suffixes(w: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Fingerprint and word number of every suffix's window, and the bins of the prefixes of each length that it goes by."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.zeros(0, np.int64)] * len(PREFIXES)
    last = np.repeat(w.first[1:], w.counts)
    at = np.flatnonzero(last[:n] >= np.arange(length, n + length))
    total, bins = np.zeros(len(hashes), np.uint64), []
    for j in range(length):
        total[: len(hashes) - j] += hashes[j:] * _ODD[j]
        if j + 1 in PREFIXES and j + 1 < length:
            here = mix(total + np.uint64(j))
            least = here[:n].copy()  # over the prefixes of this length that begin and end inside each window
            for k in range(1, length - j):
                np.minimum(least, here[k : n + k], out=least)
            bins.append((mix(least[at]) >> np.uint64(64 - BITS)).astype(np.int64))
    return mix(total[at]), at, bins


@dataclass
class Plan:
    """Where suffixes go: for each prefix length the part of each bin, or -1 where the prefix is too frequent."""

    length: int
    parts: int
    chunks: int
    tables: list[np.ndarray]
    fingerprint: int = FINGERPRINT

    def part(self, fingerprint: np.ndarray, bins: list[np.ndarray]) -> np.ndarray:
        out = (fingerprint % np.uint64(self.parts)).astype(np.int64)  # the whole window as prefix
        for table, found in zip(reversed(self.tables), reversed(bins), strict=True):
            given = table[found]
            out = np.where(given >= 0, given, out)
        return out


def count(docs: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """Suffixes by prefix length and bin (len(PREFIXES) x 2^BITS), and bytes of text, of the whole corpus."""

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros((len(PREFIXES), 1 << BITS), np.int64), 0
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"))
                size += len(w.raw)
                for k, bins in enumerate(suffixes(w, w.hashes(), length)[2]):
                    total[k] += np.bincount(bins, minlength=1 << BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total.ravel()[at], size))], ["bin", "n"])

    total, size = np.zeros(len(PREFIXES) << BITS, np.int64), 0
    # At most len(PREFIXES) x 2^BITS sums and one come to the driver.
    for row in docs.select("text").mapInArrow(frugal(tally), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        if row["bin"] < 0:
            size = row["n"]
        else:
            total[row["bin"]] = row["n"]
    return total.reshape(len(PREFIXES), -1), size


def plan(docs: DataFrame, length: int = LENGTH, part_rows: int = PART_ROWS) -> Plan:
    counts, size = count(docs, length)
    parts = max(1, -(-int(counts[0].sum()) // part_rows))
    limit = max(1, part_rows // 4)
    load, tables = np.zeros(parts), []
    for k, held in enumerate(counts):
        table = np.full(1 << BITS, -1, np.int64)
        fits = np.flatnonzero((held > 0) & (held <= limit))
        # A bin of longer prefixes also counts suffixes that a shorter one has placed; those it really gets are the share of too frequent ones.
        share = 1.0 if not k else float(counts[k - 1][counts[k - 1] > limit].sum()) / max(1, int(counts[0].sum()))
        for b in fits[np.argsort(-held[fits], kind="stable")]:
            to = int(load.argmin())
            table[b] = to
            load[to] += held[b] * share
        tables.append(table)
    return Plan(length, parts, max(LEAST_CHUNKS, -(-size // CHUNK_BYTES)), tables)


def _order(ids: np.ndarray, texts: pa.ChunkedArray) -> np.ndarray:
    """Rows by id, those of equal id by a hash of their text."""
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order][1:] == ids[order][:-1])
    tied = np.unique(order[np.concatenate([same, same + 1])])
    if not len(tied):
        return order
    digest = np.zeros((len(ids), 2), np.uint64)
    for k, text in zip(tied, texts.take(pa.array(tied)).to_pylist(), strict=True):
        digest[k] = np.frombuffer(hashlib.blake2b((text or "").encode(), digest_size=16).digest(), np.uint64)
    return np.lexsort((digest[:, 1], digest[:, 0], ids))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values))


class _Chunk:
    """The suffixes of a chunk's texts in order of document, and what it asks each part: sorted fingerprints, once each."""

    def __init__(self, table: pa.Table, plan: Plan):
        ids = table.column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy()
        self.order = _order(ids, table.column("text"))
        self.ids, self.plan = ids[self.order], plan
        texts = table.column("text").take(pa.array(self.order))
        self.w = Words(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
        self.hashes = self.w.hashes()
        fingerprint, self.at, bins = suffixes(self.w, self.hashes, plan.length)
        self.doc = self.ids[self.w.rows()[self.at]]
        self.part = plan.part(fingerprint, bins)
        self.key = (self.part.astype(np.uint64) << np.uint64(32)) | (fingerprint >> np.uint64(64 - plan.fingerprint))
        self.fingerprint = fingerprint >> np.uint64(64 - 2 * plan.fingerprint)  # twice as long where nothing has to be sent
        every = np.sort(self.key)
        new = np.append(True, every[1:] != every[:-1]) if len(every) else np.zeros(0, bool)
        self.asked, self.shared = every[new], np.diff(np.append(np.flatnonzero(new), len(every))) > 1
        ends = _runs(self.asked >> np.uint64(32))
        self.runs = {int(self.asked[a] >> np.uint64(32)): (int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)}

    def judged(self, told: pa.Table) -> None:
        """Takes in which fingerprints other chunks have too, and numbers the windows that may repeat by their words.

        ``found``: their suffixes; ``window``: the number of each one's window; by number ``first`` (a suffix of the smallest
        document), ``away`` (other chunks may have it), ``before`` and ``behind`` (the word there, -1 for none or several).
        """
        away = np.zeros(len(self.asked), bool)
        self.bits = dict(zip(told.column("part").to_pylist(), told.column("bits").to_pylist(), strict=True))
        for part, bits in self.bits.items():
            a, b = self.runs[part]
            away[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        n = self.plan.length
        self.found, of = self._having(away | self.shared)
        begin = self.at[self.found]
        inside = np.zeros(len(self.w) + 2, bool)
        for j in range(-1, n + 1):
            inside[np.maximum(begin + j, 0)] = True
        placed = np.flatnonzero(inside[: len(self.w)])
        number = np.full(len(self.w), -1, np.int64)
        number[placed] = self.w.numbered(placed, self.hashes)[0]
        self.window, rep = grouped(self.fingerprint[self.found])
        like = begin[rep][self.window]
        if not all((number[begin + j] == number[like + j]).all() for j in range(n)):  # windows that share a fingerprint: go by their words
            labels = np.stack([number[begin + j] for j in range(n)], 1)
            _, rep, self.window = np.unique(labels, axis=0, return_index=True, return_inverse=True)
            self.window = self.window.ravel()
        self.first = rep  # suffixes come by document, so the first is of the smallest
        self.away = away[of[rep]]
        first = self.w.first
        row = self.w.rows()[begin] if len(begin) else begin
        before = np.where(begin > first[row], number[np.maximum(begin - 1, 0)], -1)
        behind = np.where(begin + n < first[row + 1], number[np.minimum(begin + n, max(len(self.w) - 1, 0))], -1) if len(begin) else begin
        self.before, self.behind = (self._one(x) for x in (before, behind))

    def _having(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes whose fingerprint is one of those wanted, and the place of each one's in ``asked``."""
        some, low = np.zeros(1 << 22, bool), np.uint64((1 << 22) - 1)
        some[self.asked[wanted] & low] = True
        found = np.flatnonzero(some[self.key & low])  # few others; the search tells
        of = np.searchsorted(self.asked, self.key[found])
        kept = wanted[of]
        return found[kept], of[kept]

    def _one(self, word: np.ndarray) -> np.ndarray:
        """Of each window the word that stands there at all its places, or -1."""
        least, most = np.full(len(self.first), np.iinfo(np.int64).max), np.full(len(self.first), -1)
        np.minimum.at(least, self.window, word)
        np.maximum.at(most, self.window, word)
        return np.where(least == most, least, -1)

    def sent(self) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The windows that go to parts, by part and place, and of each part the stretch of them."""
        out = np.flatnonzero(self.away)
        part = self.part[self.found[self.first[out]]]
        order = np.lexsort((self.first[out], part))
        out, part = out[order], part[order]
        ends = _runs(part)
        return out, [(int(part[a]), int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _ask(plan: Plan) -> Callable:
    """Of a chunk the fingerprints of its windows, sorted: low halves, and steps of the high halves, which pack well."""

    def ask(table: pa.Table) -> pa.Table:
        chunk, rows = _Chunk(table, plan), []
        for part, (a, b) in chunk.runs.items():
            value = (chunk.asked[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows.append((part, (value & 0xFFFF).astype(np.uint16).tobytes(), np.diff(value >> 16, prepend=np.uint32(0)).astype(np.uint16).tobytes()))
        part, low, step = zip(*rows, strict=True) if rows else ((),) * 3
        return pa.table([pa.array([table.column(CHUNK)[0].as_py()] * len(rows), pa.int32()), pa.array(part, pa.int32()), pa.array(low, pa.binary()), pa.array(step, pa.binary())], ["chunk", "part", "low", "step"])

    return ask


def _tell(table: pa.Table) -> pa.Table:
    """A bit for each fingerprint of a chunk that another chunk has too."""
    chunks, part = table.column("chunk").to_pylist(), table.column("part")[0].as_py()
    values = []
    for low, step in zip(table.column("low").to_pylist(), table.column("step").to_pylist(), strict=True):
        high = np.cumsum(np.frombuffer(step, np.uint16), dtype=np.uint32)
        values.append((high << np.uint32(16)) | np.frombuffer(low, np.uint16))
    every = np.sort(np.concatenate(values))
    several = np.unique(every[1:][every[1:] == every[:-1]])
    told = [(c, np.isin(v, several, assume_unique=True)) for c, v in zip(chunks, values, strict=True)]
    told = [(c, np.packbits(x).tobytes()) for c, x in told if x.any()]
    return pa.table([pa.array([c for c, _ in told], pa.int32()), pa.array([part] * len(told), pa.int32()), pa.array([b for _, b in told], pa.binary())], ["chunk", "part", "bits"])


SUFFIXES = "chunk int, part int, bits binary, text binary, ends binary, sizes binary, lead binary, several binary, docs binary, runs binary"
_SUFFIXES = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), *((x, pa.binary()) for x in ("bits", "text", "ends", "sizes", "lead", "several", "docs", "runs"))])


def _send(plan: Plan) -> Callable:
    """Of a chunk, for each part, its distinct suffixes that other chunks may have: the stretches of text that hold them, how many begin in each, whether a word leads, and by suffix whether several words stand before or behind."""

    def send(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return pa.Table.from_pylist([], schema=_SUFFIXES)
        chunk, rows = _Chunk(table, plan), []
        chunk.judged(told)
        out, stretches = chunk.sent()
        w, raw = chunk.w, memoryview(np.ascontiguousarray(chunk.w.raw))
        place = chunk.found[chunk.first[out]]
        begin, doc = chunk.at[place], chunk.doc[place]
        row = w.rows()[begin] if len(begin) else begin
        for part, a, b in stretches:
            own, of = begin[a:b], row[a:b]
            new = np.flatnonzero(np.append(True, (own[1:] != own[:-1] + 1) | (of[1:] != of[:-1])))
            size = np.diff(np.append(new, b - a))
            first, of = own[new], of[new]
            lead = first > w.first[of]
            behind = np.minimum(first + size + plan.length - 1, w.first[of + 1] - 1)
            starts, ends = w.starts[first - lead], w.ends[behind]
            several = np.stack([chunk.before[out[a:b]] < 0, chunk.behind[out[a:b]] < 0])
            of_doc = _runs(doc[a:b])
            rows.append((
                part, chunk.bits[part], b"".join([raw[x:y] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]), np.cumsum(ends - starts).astype(np.uint32).tobytes(), size.astype(np.uint32).tobytes(),
                lead.astype(np.uint8).tobytes(), np.packbits(several).tobytes(), doc[a:b][of_doc[:-1]].tobytes(), np.diff(of_doc).astype(np.uint32).tobytes(),
            ))
        columns = zip(*rows, strict=True) if rows else ((),) * 9
        number = table.column(CHUNK)[0].as_py()
        return pa.table([pa.array([number] * len(rows), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, _SUFFIXES.types[1:], strict=True))], schema=_SUFFIXES)

    return send


@dataclass
class Tree:
    """The suffix tree of some word sequences, cut at their length, as an array: suffixes in lexicographic order and the common-prefix lengths of neighbours.

    An internal node of depth d is a maximal stretch of neighbours whose common prefixes are d words or longer.
    """

    order: np.ndarray
    common: np.ndarray

    @classmethod
    def of(cls, labels: np.ndarray) -> Tree:
        """labels: rows of word ranks."""
        n, length = labels.shape
        pair = lambda j: (labels[:, j].astype(np.uint64) << np.uint64(32)) | (labels[:, j + 1].astype(np.uint64) if j + 1 < length else np.uint64(0))
        order = np.lexsort([pair(j) for j in range(0, length, 2)][::-1])
        common, going = np.zeros(max(n - 1, 0), np.int64), np.ones(max(n - 1, 0), bool)
        for j in range(length):
            column = labels[order, j]
            going &= column[1:] == column[:-1]
            common += going
        return cls(order, common)

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the nodes of at least this depth, single leaves included, where each begins in the order, and the node of each suffix in it."""
        new = np.append(True, self.common < depth) if len(self.order) else np.zeros(0, bool)
        return np.flatnonzero(new), np.cumsum(new) - 1


def _ranked(w: Words) -> np.ndarray:
    """Of each word its rank among all in the order of their bytes, from 1."""
    number, place = w.numbered(np.arange(len(w)), w.hashes())
    size = (w.ends - w.starts)[place]
    raw = b"".join([w.raw[a:b].tobytes() for a, b in zip(w.starts[place], w.ends[place], strict=True)])
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    spelt = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
    rank = np.empty(len(place), np.int32)
    rank[pc.array_sort_indices(spelt).to_numpy()] = np.arange(1, len(place) + 1)
    return rank[number]


def _judge(length: int) -> Callable:
    """The subtree of one part: of each suffix whether a smaller document has it, and whether its node branches to the left or the right."""

    def judge(table: pa.Table) -> pa.Table:
        packed = {c: table.column(c).to_pylist() for c in _SUFFIXES.names}
        whole = lambda c, kind: [np.frombuffer(x, kind) for x in packed[c]]
        ends, sizes = whole("ends", np.uint32), whole("sizes", np.uint32)
        bounds = np.cumsum([len(x) for x in packed["text"]]) - [len(x) for x in packed["text"]]
        offsets = np.append(0, np.concatenate([e.astype(np.int64) + b for e, b in zip(ends, bounds, strict=True)]))
        text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(packed["text"])))
        w = Words(text)
        rank, size, lead = _ranked(w), np.concatenate(sizes).astype(np.int64), np.concatenate(whole("lead", np.uint8)).astype(bool)
        n = int(size.sum())
        inner = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        begin = np.repeat(w.first[:-1] + lead, size) + inner
        label = np.stack([rank[begin + j] for j in range(length)], 1)
        held = [int(x.sum()) for x in sizes]
        several = np.concatenate([np.unpackbits(x, count=2 * k).reshape(2, k) for x, k in zip(whole("several", np.uint8), held, strict=True)], 1).astype(bool)
        before = np.where(several[0] | ((inner == 0) & ~np.repeat(lead, size)), 0, rank[np.maximum(begin - 1, 0)])
        behind = np.where(several[1] | (begin + length >= np.repeat(w.first[1:], size)), 0, rank[np.minimum(begin + length, len(rank) - 1)])
        doc = np.concatenate([np.repeat(d, r) for d, r in zip(whole("docs", np.int64), whole("runs", np.uint32), strict=True)])
        tree = Tree.of(label)
        first, node = tree.nodes(length)
        doc = doc[tree.order]
        flags = np.zeros((3, n), bool)
        flags[0, tree.order] = doc > np.minimum.reduceat(doc, first)[node]
        for k, word in ((1, before[tree.order]), (2, behind[tree.order])):
            least, most = np.minimum.reduceat(word, first), np.maximum.reduceat(word, first)
            flags[k, tree.order] = ((least != most) | (least == 0))[node]
        upto = np.append(0, np.cumsum(held))
        told = [np.packbits(flags[:, a:b]).tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)]
        return pa.table([table.column("chunk").combine_chunks(), table.column("part").combine_chunks(), table.column("bits").combine_chunks(), pa.array(told, pa.binary())], ["chunk", "part", "bits", "flags"])

    return judge


class _Verdict:
    """Of a chunk, which words go, and the maximal repeats they are in."""

    def __init__(self, table: pa.Table, told: pa.Table, plan: Plan):
        chunk = _Chunk(table, plan)
        self.w, self.order, self.length = chunk.w, chunk.order, plan.length
        chunk.judged(told)
        smaller = np.zeros(len(chunk.first), bool)
        left, right = chunk.before < 0, chunk.behind < 0
        out, stretches = chunk.sent()
        flags = dict(zip(told.column("part").to_pylist(), told.column("flags").to_pylist(), strict=True))
        for part, a, b in stretches:
            got = np.unpackbits(np.frombuffer(flags[part], np.uint8), count=3 * (b - a)).reshape(3, -1).astype(bool)
            smaller[out[a:b]], left[out[a:b]], right[out[a:b]] = got[0], got[1], got[2]
        doc = chunk.doc[chunk.found]
        repeat = smaller[chunk.window] | (doc > doc[chunk.first][chunk.window])
        self.begin = chunk.at[chunk.found[repeat]]
        self.left, self.right = left[chunk.window][repeat], right[chunk.window][repeat]
        self.removed = covered(len(self.w), self.begin, plan.length)

    def passages(self) -> pa.Array:
        """The maximal repeats of each text: stretches of repeats that follow each other without branching between them."""
        begin, w = self.begin, self.w
        row = w.rows()[begin] if len(begin) else begin
        new = np.ones(len(begin), bool)
        new[1:] = (begin[1:] != begin[:-1] + 1) | (row[1:] != row[:-1]) | self.right[:-1] | self.left[1:]
        a = np.flatnonzero(new)
        size = np.diff(np.append(a, len(begin))) + self.length - 1
        cuts = np.searchsorted(row[a], np.arange(len(w.counts) + 1))
        runs = pa.StructArray.from_arrays([pa.array((begin[a] - w.first[row[a]]).astype(np.int32)), pa.array(size.astype(np.int32))], ["start", "words"])
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), runs)

    def texts(self) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of each text, joined by one space: bytes and offsets."""
        w = self.w
        raw, keep = w.raw.copy(), np.zeros(len(w.raw) + 1, np.int8)
        starts, ends = w.starts[~self.removed], w.ends[~self.removed]
        spaced = np.flatnonzero(ends < np.repeat(w.offsets[1:], w.counts)[~self.removed])
        raw[ends[spaced]] = 32
        keep[starts] += 1
        stop = ends.copy()
        stop[spaced] += 1
        keep[stop] -= 1
        keep = np.cumsum(keep[:-1], dtype=np.int8) > 0
        at = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
        out = raw[keep]
        # A space behind a text's last word goes.
        tail = at[1:][(np.diff(at) > 0)] - 1
        tail = tail[out[tail] == 32]
        gone = np.zeros(len(out) + 1, np.int64)
        gone[tail + 1] = 1
        at = at - np.cumsum(gone)[at]
        return np.delete(out, tail), at


def _dealt(docs: DataFrame, chunks: int) -> DataFrame:
    return docs.withColumn(CHUNK, F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))


def _verdicts(docs: DataFrame, length: int, part_rows: int, finish: Callable, schema: str | T.StructType, fingerprint: int = FINGERPRINT) -> DataFrame:
    arrow_rows(docs.sparkSession)
    p = replace(plan(docs, length, part_rows), fingerprint=fingerprint)
    settled(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(p)  # bounded: len(PREFIXES) tables of 2^BITS entries
    chunked = _dealt(docs, p.chunks)
    asked = chunked.groupBy(CHUNK).applyInArrow(frugal(lambda t: _ask(held.value)(t)), "chunk int, part int, low binary, step binary")
    shared = asked.groupBy("part").applyInArrow(frugal(_tell), "chunk int, part int, bits binary")
    sent = chunked.groupBy(CHUNK).cogroup(shared.groupBy("chunk")).applyInArrow(frugal(lambda a, b: _send(held.value)(a, b)), SUFFIXES)
    told = sent.groupBy("part").applyInArrow(frugal(_judge(length)), "chunk int, part int, bits binary, flags binary")
    return chunked.groupBy(CHUNK).cogroup(told.groupBy("chunk")).applyInArrow(frugal(lambda a, b: finish(a, _Verdict(a, b, held.value))), schema)


def digests(docs: DataFrame, length: int = LENGTH, part_rows: int = PART_ROWS, fingerprint: int = FINGERPRINT) -> DataFrame:
    """doc_id, n_words, n_removed, SHA-256 of the kept words and the maximal repeats that it has from smaller documents (first word and number of words)."""

    def finish(table: pa.Table, verdict: _Verdict) -> pa.Table:
        w, removed = verdict.w, verdict.removed
        raw, at = verdict.texts()
        sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        ids = table.column("doc_id").cast(pa.int64()).take(pa.array(verdict.order))
        return pa.table([ids, pa.array(w.counts.astype(np.int64)), pa.array(sums(removed, w.first)), pa.array(sha, pa.string()), verdict.passages()], ["doc_id", "n_words", "n_removed", "kept_sha256", "passages"])

    return _verdicts(docs.select("doc_id", "text"), length, part_rows, finish, DIGESTS, fingerprint)


def deduplicated(docs: DataFrame, length: int = LENGTH, part_rows: int = PART_ROWS) -> DataFrame:
    """docs with repeated passages cut out of their texts; a text that loses words becomes its kept words joined by one space, one that loses all its words goes."""
    names = docs.columns

    def finish(table: pa.Table, verdict: _Verdict) -> pa.Table:
        lost = sums(verdict.removed, verdict.w.first)
        raw, at = verdict.texts()
        table = table.select(names).take(pa.array(verdict.order))
        old = table.column("text").to_pylist()
        texts = [raw[a:b].tobytes().decode() if n else t for t, n, a, b in zip(old, lost, at[:-1], at[1:], strict=True)]
        table = table.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
        return table.filter(pa.array((lost == 0) | (lost < verdict.w.counts)))

    return _verdicts(docs, length, part_rows, finish, docs.schema)


#: The digests by plain windows of words, for DuckDB.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM w WHERE len(w) >= 13)),
m AS (SELECT key, min(doc_id) AS first_id FROM x GROUP BY key),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS i FROM x JOIN m USING (key) WHERE first_id < doc_id),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT t.doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY t.i) FILTER (WHERE g.i IS NULL) AS kept FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.i = g.i GROUP BY t.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

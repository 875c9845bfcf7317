"""Words, word hashes and word windows of Arrow text columns, in whole-column numpy operations.

A word is a maximal run of bytes other than ``\\x20 \\x09-\\x0D``; in UTF-8 that equals the pattern
``[^\\x20\\x09-\\x0D]+`` over code points. Null texts have no words. Nothing here loops over words or characters in
Python, so a pass over whole texts costs a few nanoseconds a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LONG_WORD = 128
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ODD = np.random.default_rng(20240229).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text (one row at least), to bound temporary arrays."""
    ends = np.cumsum(lengths(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1, from 0) of a string array; null rows are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + n + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lengths(array: pa.Array) -> np.ndarray:
    return np.diff(buffers(array)[1])


class Words:
    """Word boundaries of every row: ``starts`` and ``ends`` (byte positions), ``first`` (word number at which each row begins, n + 1)."""

    def __init__(self, array: pa.Array):
        self.raw, self.offsets = buffers(array)
        word = ~SPACE[self.raw]
        n = len(word)
        begin, end = word.copy(), word.copy()
        if n:
            begin[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            begin[cuts] = word[cuts]
            end[cuts - 1] = word[cuts - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        size = self.ends - self.starts
        padded = np.zeros(len(self.raw) + 8, np.uint8)
        padded[: len(self.raw)] = self.raw
        eights = np.ndarray((len(self.raw) + 1,), "<u8", padded.data, strides=(1,))
        out = mix((eights[self.starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _C3)
        more = np.flatnonzero(size > 8)
        huge = more[size[more] > LONG_WORD]
        more, at = more[size[more] <= LONG_WORD], 8
        while len(more):
            left = size[more] - at
            out[more] = mix(out[more] * _ODD[at // 8] + (eights[self.starts[more] + at] & _MASK[np.minimum(left, 8)]))
            at += 8
            more = more[size[more] > at]
        for k in huge:
            out[k] = int.from_bytes(hashlib.blake2b(self.raw[self.starts[k] : self.ends[k]].tobytes(), digest_size=8).digest(), "little")
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a[i] and b[i] have the same bytes."""
        size = self.ends - self.starts
        out = size[a] == size[b]
        padded = np.zeros(len(self.raw) + 8, np.uint8)
        padded[: len(self.raw)] = self.raw
        eights = np.ndarray((len(self.raw) + 1,), "<u8", padded.data, strides=(1,))
        left, at = np.flatnonzero(out), 0
        while len(left):
            mask = _MASK[np.minimum(size[a[left]] - at, 8)]
            equal = (eights[self.starts[a[left]] + at] & mask) == (eights[self.starts[b[left]] + at] & mask)
            out[left[~equal]] = False
            at += 8
            left = left[equal]
            left = left[size[a[left]] > at]
        return out

    def numbered(self, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words at some places a number each, equal for equal words alone, and a place of each number's word."""
        number, first = grouped(hashes[at])
        if self.same(at, at[first][number]).all():
            return number, at[first]
        seen: dict[bytes, int] = {}  # words that share a hash: go by their bytes
        number = np.array([seen.setdefault(self.raw[self.starts[k] : self.ends[k]].tobytes(), len(seen)) for k in at], np.int64)
        return number, at[np.unique(number, return_index=True)[1]]

    def windows(self, hashes: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all windows of k words inside a row, and the word number at which each begins."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        last = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(last[:n] >= np.arange(k, n + k))
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += hashes[j : j + n] * _ODD[(j + 17 * salt) % 256]
        return mix(total[at]), at


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each value, equal for equal ones, in order of appearance, and where each number first stands."""
    coded = pa.array(values).dictionary_encode()
    number = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[number[::-1]] = np.arange(len(values))[::-1]
    return number, first


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Of n words, those inside a window of k words that begins at one of ``at`` (each once)."""
    steps = np.zeros(n + 1, np.int32)
    steps[at] += 1
    steps[at + k] -= 1
    return np.cumsum(steps[:-1], dtype=np.int32) > 0


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; empty runs give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]

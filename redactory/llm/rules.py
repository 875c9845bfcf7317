"""Quality rules by tokeniser fertility.

``quality(docs, ...)`` measures every whole text in one pass without a shuffle: base counts of words, symbols, repeated
lines and repeated 3-word windows, then what a public vocabulary makes of the text: characters per token, share of
tokens that are not whole UTF-8 characters (bytes the vocabulary had to fall back on) and entropy of the token
distribution. Each script has a band; a text outside the band of its main script is rejected. Entropy grows with the
number of tokens, so the Latin band bounds it by that number.

Defined results: null or empty text: all counts 0, base_failed true, kept false. Tied scripts: the first of SCRIPTS.
Repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .session import arrow_rows
from .words import Words, covered, mix, slices, sums

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokeniser pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Texts are tokenised in pieces of about so many characters, which bounds the tokeniser's memory. Pieces end where the pattern
#: ends a token in any case, before a single space between a visible character and a letter, so they change no token.
PIECE = 200_000
_CUT = regex.compile(r"(?<=\S) (?=\p{L})")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string"


@dataclass(frozen=True)
class Band:
    """Bounds within which a text of a script passes. Entropy is held against log2 of the token count, its largest value, and
    where ``entropy_bits`` is given against the line through its points (log2 of the token count, bits)."""

    chars_per_token: tuple[float, float]
    byte_share: float
    entropy_share: float
    entropy_bits: tuple[tuple[float, float], ...] = ()


#: 0.004 log2(n) under the 0.1 % quantile of the residuals of a parabola through entropy / log2(n) by log2(n),
#: over the labelled documents of quality 1 with even id that pass the base rules (sf0.1); level where longer ones are few.
LATIN_BITS = ((0.0, 0.0), (6.0, 5.14), (7.0, 5.53), (8.0, 5.82), (9.0, 6.03), (10.0, 6.16), (11.0, 6.22))


#: By script: its code-point range and band. Byte-level vocabularies made from Latin text spend up to three byte tokens on a character of other scripts.
SCRIPTS: dict[str, tuple[tuple[int, int], Band]] = {
    "latin": ((0x41, 0x24F), Band((1.45, 12.0), 0.25, 0.35, LATIN_BITS)),
    "greek": ((0x370, 0x3FF), Band((0.6, 8.0), 0.8, 0.3)),
    "cyrillic": ((0x400, 0x52F), Band((0.6, 8.0), 0.8, 0.3)),
    "hebrew": ((0x590, 0x5FF), Band((0.5, 8.0), 0.9, 0.3)),
    "arabic": ((0x600, 0x6FF), Band((0.5, 8.0), 0.9, 0.3)),
    "indic": ((0x900, 0xDFF), Band((0.3, 8.0), 1.0, 0.3)),
    "cjk": ((0x3040, 0x9FFF), Band((0.3, 6.0), 1.0, 0.3)),
    "hangul": ((0xAC00, 0xD7A3), Band((0.3, 6.0), 1.0, 0.3)),
}


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    if not os.path.exists(path):
        raise FileNotFoundError(f"{path}: the vocabulary must lie under this path on every executor")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    part = np.zeros(max(ranks.values()) + 1, bool)
    for token, k in ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            part[k] = True
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), part


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about size characters that have the tokens that it has as a whole."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + size) if at + size < len(text) else None
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to


def fertility(text: str, path: str) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share and entropy in bits."""
    if not text:
        return 0, 0.0, 0.0, 0.0
    encoding, part = _encoding(path)
    ids = np.concatenate([np.array(encoding.encode_ordinary(x), np.int32) for x in pieces(text)])
    n = len(ids)
    ids.sort()
    share = np.diff(np.flatnonzero(np.diff(ids, prepend=-1, append=-1))) / n
    return n, len(text) / n, float(part[ids].mean()), float(-(share * np.log2(share)).sum())


def script_of(text: str) -> str:
    """The script of most letters; latin if there are none."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    found = {name: int(((points >= low) & (points <= high)).sum()) for name, ((low, high), _) in SCRIPTS.items()}
    return max(found, key=found.get)


def passes(n: int, chars_per_token: float, byte_share: float, entropy: float, band: Band) -> bool:
    low, high = band.chars_per_token
    most = np.log2(max(n, 2))
    least = max(band.entropy_share * most, np.interp(most, *zip(*band.entropy_bits, strict=True)) if band.entropy_bits else 0.0)
    return bool(low <= chars_per_token <= high and byte_share <= band.byte_share and entropy >= least)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text that need no vocabulary."""
    w = Words(texts)
    n = w.counts
    inside = np.zeros(len(w.raw) + 1, np.int32)
    np.cumsum(~((w.raw & 0xC0) == 0x80), out=inside[1:])
    chars = sums(inside[w.ends] - inside[w.starts], w.first)
    keys, at = w.windows(w.hashes(), 3)
    keys = mix(keys + mix(w.rows()[at].astype(np.uint64)))
    _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
    repeat = covered(len(w), at[count[where] > 1], 3) if len(at) else np.zeros(len(w), bool)
    dup = []
    for text in texts.to_pylist():
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        dup.append(len(lines) - len(set(lines)))
    return {"n_words": n, "word_chars": chars, "n_symbols": sums(SYMBOLS[w.raw], w.offsets), "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": sums(repeat, w.first)}


def quality(docs: DataFrame, vocabulary: str = VOCABULARY, scripts: dict = SCRIPTS) -> DataFrame:
    """One row per document; see the module's text."""
    arrow_rows(docs.sparkSession)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                out = base_counts(texts)
                n = out["n_words"]
                failed = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
                told = []
                for text, bad in zip(texts.to_pylist(), failed, strict=True):
                    figures, script = fertility(text or "", vocabulary), script_of(text or "")
                    told.append((*figures, script, not bad and passes(*figures, scripts[script][1])))
                tokens, ratio, share, entropy, script, kept = zip(*told, strict=True)
                columns = [part.column("doc_id").cast(pa.int64()), *map(pa.array, out.values()), pa.array(failed), pa.array(kept), pa.array(tokens, pa.int64()), pa.array(ratio), pa.array(share), pa.array(entropy), pa.array(script)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(measure, SCHEMA)

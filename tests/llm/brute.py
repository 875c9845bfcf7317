"""Brute-force versions of the operators, over Python lists."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_counts(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    dup, seen = 0, set()
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def substrings(rows, length=13):
    """rows: (doc_id, text); {doc_id: (n_words, n_removed, sha)} for unique ids."""
    first, split = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = split[i] = words(text)
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), i)
    out = {}
    for i, w in split.items():
        gone = {j for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < i for j in range(k, k + length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept
    return out


def maximal_repeats(rows, length=13):
    """{doc_id: [(first word, words)]}: stretches of windows that a smaller document has, cut where their places in all texts are not the same, moved by one."""
    split = {i: words(t) for i, t in rows}
    places = defaultdict(set)
    for i, w in split.items():
        for k in range(len(w) - length + 1):
            places[tuple(w[k : k + length])].add((i, k))
    out = {}
    for i, w in split.items():
        found, last = [], None
        for k in range(len(w) - length + 1):
            now = places[tuple(w[k : k + length])]
            if min(now)[0] >= i:
                last = None
                continue
            if last is not None and {(j, at + 1) for j, at in last} == now:
                found[-1][1] += 1
            else:
                found.append([k, length])
            last = now
        out[i] = [tuple(x) for x in found]
    return out


def near_classes(rows, threshold=0.8, k=5):
    """{doc_id: smallest id of its class} by all pairs of distinct texts."""
    by_text = defaultdict(list)
    for i, text in rows:
        by_text[text].append(i)
    texts = [t for t in by_text if words(t)]
    sets = [{tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)} for w in map(words, texts)]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and shared / (len(sets[a]) + len(sets[b]) - shared) >= threshold:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for a, t in enumerate(texts):
        groups[find(a)] += by_text[t]
    return {i: min(g) for g in groups.values() for i in g} | {i: i for t in by_text if not words(t) for i in by_text[t]}


def top_k(vectors, queries, k=5):
    out = {}
    for q, x in queries:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in vectors if i != q and len(y) == len(x))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def trigram_codes(text, bits):
    """Codes of the byte trigrams of a text's letters, words set apart by one space."""
    folded = bytearray()
    raw = (text or "").encode()
    for k, x in enumerate(raw):
        if 65 <= x <= 90 or 97 <= x <= 122:
            folded.append(x | 32)
        elif x >= 128:
            folded.append(x + 32 if k and raw[k - 1] == 0xC3 and 0x80 <= x <= 0x9E and x != 0x97 else x)
        elif x in (9, 10, 11, 12, 13, 32):
            folded.append(32)
    told = re.sub(rb" +", b" ", bytes(folded))
    told = b" " + told
    out = []
    for k in range(len(told) - 2):
        code = (told[k] * 0x9E3779B1 + told[k + 1] * 0x85EBCA6B + told[k + 2] * 0xC2B2AE35) & 0xFFFFFFFF
        code ^= code >> 15
        out.append(((code * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - bits))
    return out


def nearest(codes, idf, centroids, owner):
    """Language number, cosine and number of trigrams, one centroid after another."""
    tf = {c: (1 + math.log(n)) for c, n in Counter(codes).items()}
    if not tf:
        return 0, 0.0, 0
    norm = math.sqrt(sum((w * float(idf[c])) ** 2 for c, w in tf.items()))
    best, found = -2.0, 0
    for j in range(centroids.shape[1]):
        cosine = sum(w * float(centroids[c, j]) for c, w in tf.items()) / norm
        if cosine > best + 1e-6:
            best, found = cosine, j
    return int(owner[found]), best, len(codes)


def quality_features(text, symbols):
    raw = text.encode()
    classes = len(symbols) + 6

    def kind(x):
        if x in symbols:
            return symbols.index(x)
        return len(symbols) + (0 if 48 <= x <= 57 else 1 if 65 <= x <= 90 else 2 if 97 <= x <= 122 else 3 if x == 10 else 4 if x in (9, 11, 12, 13, 32) else 5)

    share = [0] * classes
    for x in raw:
        share[kind(x)] += 1
    w = [x.encode() for x in words(text)]
    n = max(len(w), 1)
    kinds = [[kind(x) for x in word] for word in w]
    small = [sum(k in (len(symbols) + 2, len(symbols) + 5) for k in ks) for ks in kinds]
    caps = [sum(k == len(symbols) + 1 for k in ks) for ks in kinds]
    marks = [sum(k < len(symbols) for k in ks) for ks in kinds]
    shapes = [
        [len(x) == 1 for x in w], [len(x) > 14 for x in w], [s == 0 for s in small], [c > 0 and s == 0 for c, s in zip(caps, small, strict=True)],
        [c > 0 and s > 0 for c, s in zip(caps, small, strict=True)], [m == len(x) for m, x in zip(marks, w, strict=True)], [m > 1 for m in marks],
        [ks[0] == len(symbols) + 1 for ks in kinds], [ks[-1] < len(symbols) for ks in kinds],
    ]
    base = base_counts(text)
    lines = raw.count(b"\n")
    more = [math.log1p(len(w)), math.log1p(len(raw)), sum(map(len, w)) / n, len(set(w)) / n, base[4] / n, base[3] / (lines + 1), lines / n]
    return [*(math.sqrt(x / max(len(raw), 1)) for x in share), *(sum(x) / n for x in shapes), *more]


def pack(sizes, lengths, overhead):
    """Bin of each piece and each bin's length: longest first, into the bin it leaves least room in; a new one of the length that costs least a word it can fill."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    free, used, bin_of = [], [], [0] * len(sizes)
    for i, k in enumerate(order):
        size = sizes[k]
        fits = [(room, b) for b, room in enumerate(free) if room >= size]
        if fits:
            b = min(fits)[1]
        else:
            costs = []
            for length in sorted(lengths):
                if length >= size:
                    spare = length - size
                    costs.append(((length + overhead) / (size + min(spare, sum(sizes[j] for j in order[i + 1 :] if sizes[j] <= spare))), length))
            b = len(free)
            free.append(min(costs)[1])
            used.append(0)
        bin_of[k] = b
        free[b] -= size
        used[b] += size
    return bin_of, [min(x for x in lengths if x >= u) for u in used]


def fertility(text, path, pattern):
    """Tokens, characters per token, share of tokens that are no whole characters, and entropy, by merging pairs of lowest rank one at a time."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    tokens = []
    for m in regex.finditer(pattern, text):
        parts = [bytes([x]) for x in m[0].encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: ranks.get(parts[k] + parts[k + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        tokens += parts
    n = len(tokens)
    if not n:
        return 0, 0.0, 0.0, 0.0

    def cut(token):
        try:
            token.decode()
        except UnicodeDecodeError:
            return True
        return False

    return n, len(text) / n, sum(map(cut, tokens)) / n, -sum(c / n * math.log2(c / n) for c in Counter(tokens).values())

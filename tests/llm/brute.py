"""Plain restatements of what the operators return, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACES = " \t\n\v\f\r"


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACES:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text):
    own = words(ascii_lower(text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows):
    """{doc_id: (fingerprint, component)}"""
    prints = {i: fingerprint(t) for i, t in rows}
    union, ids = Union(prints), sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                union.link(i, j)
    return {i: (f"{prints[i]:016x}", union.find(i)) for i in ids}


def similar(rows, shingle=5, least=0.8):
    """{doc_id: smallest id of its group}, linked by Jaccard similarity of word shingles"""
    sets = {}
    for i, t in rows:
        own = words(ascii_lower(t or ""))
        sets[i] = {tuple(own[k : k + shingle]) for k in range(max(1, len(own) - shingle + 1))}
    union, ids = Union(sets), sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                union.link(i, j)
    return {i: union.find(i) for i in ids}


def substrings(rows, window=20):
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    first, own = {}, {i: words(t) for i, t in rows}
    for i in sorted(own):
        for s in range(len(own[i]) - window + 1):
            first.setdefault(tuple(own[i][s : s + window]), (i, s))
    out = {}
    for i, w in own.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def vectors(rows, least=0.98):
    """{vec_id: (n_links, component, kept)}"""
    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            good[i] = (label, x / np.linalg.norm(x))
    union, links = Union([r[0] for r in rows]), Counter()
    ids = sorted(good)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            (la, a), (lb, b) = good[i], good[j]
            if la == lb and len(a) == len(b) and float(a @ b) >= least:
                union.link(i, j)
                links[i] += 1
                links[j] += 1
    return {r[0]: (links[r[0]], union.find(r[0]), union.find(r[0]) == r[0]) for r in rows}


def lines(rows, min_chars=40, min_docs=5):
    """{doc_id: (n_lines, n_dropped, kept text)}"""
    split = {i: (t or "").split("\n") for i, t in rows}
    key = lambda line: ascii_lower(line.strip(SPACES))
    holders = defaultdict(set)
    for i, own in split.items():
        for line in own:
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = {}
    for i, own in split.items():
        kept = [line for line in own if gone.get(key(line), i) == i]
        out[i] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    own, text = words(text), text or ""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(own, own[1:], own[2:]))
    covered = {k + s for k, t in enumerate(zip(own, own[1:], own[2:])) if windows[t] > 1 for s in range(3)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def _grams(text):
    """Buckets of tokens and of pairs of neighbours."""
    mask = (1 << 64) - 1
    h = [xxhash.xxh3_64_intdigest(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    return [x >> 48 for x in h] + [(((a * 0x9E3779B97F4A7C15 + b) & mask) * 0xBF58476D1CE4E5B9 & mask) >> 48 for a, b in zip(h, h[1:])]


def quality(rows, good, fits):
    """{doc_id: (score, kept)}; ``good`` by labelled id, ``fits`` the ids of the target"""
    size = 1 << 16
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(_grams(t))
        if i in fits:
            target.update(_grams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def ratio(b):
        p = (raw[b] + 1) / (n_raw + size)
        smooth = 0.05 * n_target
        return math.log((target[b] + smooth * p) / (n_target + smooth) / p) if n_target else 0.0

    score, failed = {}, {}
    for i, t in rows:
        g = _grams(t)
        score[i] = sum(map(ratio, g)) / len(g) if g else 0.0
        n, _, _, _, rep = base(t)
        failed[i] = n < 50 or 100 * rep > 50 * n
    judged = [(math.floor(score[i] * 1000), good[i]) for i in score if i in good and i not in fits and not failed[i]]
    goods, bads = sum(g for _, g in judged), sum(1 - g for _, g in judged)
    least = -math.inf
    if goods and bads:
        value = {c: 2 * sum(g for x, g in judged if x >= c) * bads + sum(1 - g for x, g in judged if x < c) * goods for c, _ in judged}
        least = min(c for c, v in value.items() if v == max(value.values())) / 1000
    return {i: (score[i], not failed[i] and score[i] >= least) for i in score}

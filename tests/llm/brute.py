"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def grams(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))) if w else frozenset()


def links(docs):
    """id -> ids with a Jaccard similarity of 0.8 or more; docs: id -> text."""
    sets = {i: grams(t) for i, t in docs.items()}
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    out = defaultdict(set)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in where[g]).items():
            if j != i and 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                out[i].add(j)
    return out


def classes(ids, linked):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in linked:
        for j in linked[i]:
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    return {i: top(i) for i in ids}


def repeats(texts, length):
    """For each text the mask of its bytes under repeated strings."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append((np.frombuffer(d, np.uint8), gone))
    return out


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen, covered = Counter(windows), [False] * len(w)
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered[i : i + 8] = [True] * 8
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(covered)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def buckets(text, size):
    """The hash buckets of words, word pairs and word ends, as Spark's xxhash64 gives them."""
    w = WORD.findall(text or "")
    one = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    two = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(one, one[1:])]
    zero = xxhash.xxh64_intdigest(struct.pack("<i", 0), 42)
    ends = [xxhash.xxh64_intdigest(x[-3:].encode(), zero) for x in w]
    return [_signed(h) % size for h in [*one, *two, *ends]]


def contained(docs, items):
    """(doc, item, shingles, found) with a containment of 0.8 or more."""
    sets = {i: grams(t) for i, t in docs.items()}
    out = set()
    for k, t in items.items():
        wanted = grams(t)
        for i, s in sets.items():
            n = len(wanted & s)
            if wanted and 5 * n >= 4 * len(wanted):
                out.add((i, k, len(wanted), n))
    return out


def runs(words, least=12):
    """(start, length, smallest period) of every maximal run, by trying every period."""
    code = {}
    w = np.array([code.setdefault(x, len(code)) for x in words])
    out = []
    for p in range(1, len(w) // 2 + 1):
        edges = np.diff(np.concatenate([[0], (w[:-p] == w[p:]).astype(int), [0]]))
        for s, e in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            n = e - s + p
            piece = w[s : s + n]
            if n >= max(least, 2 * p) and not any((piece[q:] == piece[:-q]).all() for q in range(1, p)):
                out.append((s, n, p))
    return sorted(out)


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words(text):
    return WORD.findall(text or "")


def trie(convs, words):
    """Nodes of the trie of id -> tuple of turns; words: turn -> words. Rows by depth, then id."""
    members, kids, out = defaultdict(list), defaultdict(list), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(out[k][5] for k in kids[p]) or 1
        saved = sum(out[k][6] for k in kids[p]) + (len(members[p]) - 1) * (words[p[-1]] if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        over = min(members[p[:-1]]) if p else None
        out[p] = (min(members[p]), len(p), over, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: (r[1], r[0]))

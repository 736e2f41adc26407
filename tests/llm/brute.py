"""Plain definitions of what the corpus operators must return, for small inputs only."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def lines(docs, min_chars=20, min_docs=3):
    held = defaultdict(set)

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    for d, text in docs:
        for line in (text or "").split("\n"):
            held[key(line)].add(d)
    out = {}
    for d, text in docs:
        own = (text or "").split("\n")
        stay = [x for x in own if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == d]
        out[d] = (len(own), len(own) - len(stay), sha("\n".join(stay)))
    return out


def leaks(docs, items, m=10):
    windows = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        if w:
            for k in range(max(1, len(w) - m + 1)):
                windows[tuple(w[k : k + m])].add(i)
    sizes = sorted({len(x) for x in windows})
    out = {}
    for d, text in docs:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def fingerprint(text, n=3):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), seed=42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs, distance=3):
    fp = {d: fingerprint(t) for d, t in docs}
    ids = sorted(fp)
    values = np.array([fp[d] for d in ids], np.uint64)
    links = [(ids[i], ids[i + 1 + j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= distance)]
    root = smallest_reachable(ids, links)
    return {d: (format(fp[d], "016x"), root[d]) for d in ids}


def substrings(docs, m=13):
    first = {}
    for d, text in docs:
        w = WORD.findall(text or "")
        for k in range(len(w) - m + 1):
            x = tuple(w[k : k + m])
            first[x] = min(first.get(x, d), d)
    out = {}
    for d, text in docs:
        w = WORD.findall(text or "")
        gone = set()
        for k in range(len(w) - m + 1):
            if first[tuple(w[k : k + m])] < d:
                gone.update(range(k, k + m))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def vectors(rows, cosine=0.98):
    """rows: (vec_id, vector, label)."""
    unit = {}
    for i, v, label in rows:
        v = None if v is None or any(x is None for x in v) else np.array(v, float)
        if label is not None and v is not None and len(v) and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            unit[i] = (label, v / np.linalg.norm(v))
    links = [(a, b) for a, b in combinations(sorted(unit), 2) if unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= cosine]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    root = smallest_reachable([r[0] for r in rows], links)
    return {i: (n[i], root[i], root[i] == i) for i, _, _ in rows}

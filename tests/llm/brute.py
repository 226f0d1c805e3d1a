"""Plain versions that the operators are held against."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = float("inf")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rank(doc_id):
    return LAST if doc_id is None else doc_id


def repeats(rows, k=13):
    """Counter of (doc_id, words, removed, kept text) of (doc_id, text) rows."""
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, LAST), rank(i))
    out = Counter()
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < rank(i):
                gone.update(range(p, p + k))
        out[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    return out


def shingles(text, k):
    w = words(lower(text))
    return {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, percent):
    """Counter of (doc_id, set size, smallest id reached)."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        if i is None:
            continue
        shared = Counter(m for g in s for m in holders[g])
        for m, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[m][1]) - both):
                a, b = sorted((find(i), find(sets[m][0])))
                root[b] = a
        for g in s:
            holders[g].append(n)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)

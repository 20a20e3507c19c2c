"""Plain versions of the operators' results, for small inputs."""

import collections
import hashlib


def classes(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def shingle_set(text, words=5):
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def near_documents(rows, words=5, percent=80):
    """[(id, set size, smallest id of the class)] of (id, text) rows."""
    sets = [shingle_set(t, words) for _, t in rows]
    links = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets[:i])
        if a and b and 100 * len(a & b) >= percent * len(a | b)
    ]
    root = classes(len(rows), links)
    least = {}
    for (key, _), r in zip(rows, root, strict=True):
        if key is not None:
            least[r] = min(key, least.get(r, key))
    return [(key, len(s), (least.get(r, key) if s else key)) for (key, _), s, r in zip(rows, sets, root, strict=True)]


def repeated_bytes(texts, length=200):
    """[(bytes, removed, spans, hash of the rest)]"""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    result = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for q in range(len(d)) if gone[q] and (q == 0 or not gone[q - 1]))
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        result.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return result

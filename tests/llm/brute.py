"""Plain versions of operators, for small tables."""

import hashlib
from collections import defaultdict


def words_of(text):
    return (text or "").encode().split()


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_groups(rows):
    """doc_id -> (set size, smallest linked id); ids are unique and not null here."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_cut(rows, window=13):
    """(doc_id, words, words removed, digest) of each row; a null id is the largest."""
    key = lambda i: float("inf") if i is None else i
    first = defaultdict(lambda: float("inf"))
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            first[k] = min(first[k], key(i))
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < key(i):
                gone.update(range(p, p + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)

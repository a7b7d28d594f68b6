"""Plain versions of the operators, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jaccard_components(rows, k=5, percent=75):
    """{doc: (size, component)} of (doc, text) rows."""
    sets = {d: shingles(t, k) for d, t in rows}
    by = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def substring(rows, window=50):
    """{doc: (words, removed, sha256)} of (doc, text) rows."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    least = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - window + 1):
            least.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out

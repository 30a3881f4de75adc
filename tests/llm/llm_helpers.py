"""Brute-force counterparts of the near-duplicate operator."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent=80):
    """Least doc_id reachable over links of (doc_id, text) rows, all pairs compared."""
    rows = [(i, shingles(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(set)
    for n, (_, s) in enumerate(rows):
        for x in s:
            by[x].add(n)
    for n, (i, s) in enumerate(rows):
        for m in {m for x in s for m in by[x] if m < n}:
            j, t = rows[m]
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}

"""Brute-force versions in plain Python."""

import re
from collections import Counter, defaultdict

AZ = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_words(text):
    return words((text or "").translate(AZ))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def repeated(rows, window):
    """Of (id, text) rows: per row the words kept."""
    big = 1 << 63
    first = {}
    for i, text in sorted(rows, key=lambda r: big if r[0] is None else r[0]):
        w = words(text)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j:j + window]), big if i is None else i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < (big if i is None else i):
                gone[j:j + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text, k):
    w = lower_words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows, k, percent):
    """Of (id, text) rows: (id, size, component) per row; a row with a null id stands alone."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        if i is None:
            continue
        common = Counter(m for g in s for m in where[g])
        for m, both in common.items():
            if 100 * both >= percent * (len(s) + len(sets[m][1]) - both):
                a, b = root(i), root(sets[m][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(n)
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]

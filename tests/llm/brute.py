"""Plain Python versions of the joins, for small tables."""

import re
from collections import defaultdict


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, k):
    w = words(text)
    if len(w) >= k:
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def links(sets, num, den):
    """Pairs of positions whose sets link; equal sets too."""
    at = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in at[x]:
                shared[j] += 1
            at[x].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                yield j, i


def components(rows, k, num, den):
    """{doc: (size, least doc reached)} of (doc, text) rows."""
    docs = [d for d, _ in rows]
    sets = [shingles(t, k) for _, t in rows]
    up = {d: d for d in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in links(sets, num, den):
        a, b = find(docs[i]), find(docs[j])
        up[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in zip(docs, sets, strict=True)}


def removed(rows, k, num, den):
    """{doc: sorted numbers of the lines that an earlier one matches} of (doc, text) rows."""
    lines = sorted((d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")))
    lines = [(d, i, s) for d, i, x in lines if (s := shingles(x, k))]
    gone = {j for _, j in links([s for _, _, s in lines], num, den)}
    out = defaultdict(list)
    for j in sorted(gone):
        out[lines[j][0]].append(lines[j][1])
    return dict(out)

"""Prefix-tree join of sets held by one task: shared paths, bounds on what remains."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class SetTrie:
    """Path-compressed trie over sets that are written in one common order.

    Tokens are numbered from the most to the least frequent of the group, so
    that near copies share long paths; any common order keeps the join exact.
    A node stands for the tokens from depth ``top`` to ``end`` that the sets
    ``first`` to ``last`` have in common, in lexicographic order.  The sets
    must differ from each other.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sets])
        every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        place = np.empty(len(counts), np.int32)
        place[np.argsort(-counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
        ends = np.cumsum(sizes)
        ordered = [np.sort(place[inverse[b - n : b]]) for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
        # the closing number, larger than all others, keeps any set from being a prefix of another
        closed = [np.append(r, np.int32(len(counts))) for r in ordered]
        packed = [r.astype(">u4").tobytes() for r in closed]
        self.order = sorted(range(len(sets)), key=packed.__getitem__)
        self.rows = [closed[i] for i in self.order]
        self.sizes = sizes[self.order] if len(sets) else sizes
        self.universe = len(counts)
        self._build()

    def _build(self) -> None:
        rows, n = self.rows, len(self.rows)
        shared = [0] * (n + 1)
        for i in range(1, n):
            a, b = rows[i - 1], rows[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            shared[i] = int(differ[0]) if len(differ) else m
        # nodes: top, end, first, last, children
        self.top, self.end, self.first, self.last, self.kids = [], [], [], [], []

        def node(top: int, end: int, first: int) -> int:
            self.top.append(top)
            self.end.append(end)
            self.first.append(first)
            self.last.append(first)
            self.kids.append([])
            return len(self.top) - 1

        root = node(0, 0, 0)
        path = [root]
        for i in range(n):
            depth = shared[i]
            below = None
            while self.end[path[-1]] > depth:
                below = path.pop()
                self.last[below] = i - 1
            if self.end[path[-1]] < depth:  # split the edge to the node just left
                middle = node(self.top[below], depth, self.first[below])
                self.top[below] = depth
                self.kids[path[-1]][-1] = middle
                self.kids[middle].append(below)
                path.append(middle)
            leaf = node(depth, len(rows[i]), i)
            self.kids[path[-1]].append(leaf)
            path.append(leaf)
        for x in path:
            self.last[x] = n - 1
        size = self.sizes.tolist()
        self.low = [0] * len(self.top)
        self.high = [0] * len(self.top)
        for x in range(len(self.top)):
            part = size[self.first[x] : self.last[x] + 1]
            self.low[x], self.high[x] = (min(part), max(part)) if part else (0, 0)
        self.leaf = [not k for k in self.kids]

    def probe(self, row: int, num: int, den: int, skip: Callable[[int], bool], found: Callable[[int], bool]) -> None:
        """Calls ``found(other)`` for each set whose Jaccard similarity to ``row`` is num/den or more.

        ``skip(node)`` leaves a subtree out; the walk ends once ``found`` returns True.
        """
        own = self.rows[row][:-1]
        n = len(own)
        if not n:
            return
        has = np.zeros(self.universe + 1, bool)
        has[own] = True
        stack = [(0, 0)]
        while stack:
            x, overlap = stack.pop()
            if skip(x):
                continue
            low, high = self.low[x], self.high[x]
            if high * den < n * num or low * num > n * den:
                continue
            end = self.end[x]
            if end > self.top[x]:
                tokens = self.rows[self.first[x]]
                overlap += int(np.count_nonzero(has[tokens[self.top[x] : end]]))
                left = n - int(np.searchsorted(own, tokens[end - 1], "right"))
            else:
                left = n
            most = overlap + min(left, max(high - end, 0))
            # overlap / (n + size - overlap) >= num / den for some size of at least `low`
            if most * (den + num) < num * (n + low):
                continue
            if self.leaf[x]:
                size = high
                if overlap * (den + num) >= num * (n + size) and self.first[x] != row and found(self.first[x]):
                    return
                continue
            stack.extend((k, overlap) for k in reversed(self.kids[x]))


def linked_components(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each set the least index it reaches by links, without listing the links.

    A subtree whose sets are all known to be in the probe's component is left out.
    """
    trie = SetTrie(sets)
    order = trie.order
    up = list(range(len(sets)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    one = [False] * len(trie.top)
    kids, first, leaf = trie.kids, trie.first, trie.leaf

    def whole(x: int) -> bool:
        if one[x] or leaf[x]:
            return True
        root = find(order[first[x]])
        if all(one[k] or leaf[k] for k in kids[x]) and all(find(order[first[k]]) == root for k in kids[x]):
            one[x] = True
        return one[x]

    for row in range(len(sets)):
        mine = order[row]

        def skip(x: int, mine: int = mine) -> bool:
            return whole(x) and find(order[first[x]]) == find(mine)

        def found(other: int, mine: int = mine) -> bool:
            a, b = find(mine), find(order[other])
            if a != b:
                up[max(a, b)] = min(a, b)
            return False

        trie.probe(row, num, den, skip, found)
    return [find(i) for i in range(len(sets))]


def linked_to_earlier(sets: list[np.ndarray], ranks: list, wanted: list[bool], num: int, den: int) -> list[bool]:
    """For each wanted set whether a set of smaller rank links with it."""
    trie = SetTrie(sets)
    place = [ranks[i] for i in trie.order]
    least = [min(place[a : b + 1]) for a, b in zip(trie.first, trie.last, strict=True)] if sets else []
    out = [False] * len(sets)
    for row in range(len(sets)):
        mine = trie.order[row]
        if not wanted[mine]:
            continue
        hit = []

        def found(other: int, rank=ranks[mine], hit: list = hit) -> bool:
            if place[other] < rank:
                hit.append(other)
            return bool(hit)

        trie.probe(row, num, den, lambda x, rank=ranks[mine]: least[x] >= rank, found)
        out[mine] = bool(hit)
    return out

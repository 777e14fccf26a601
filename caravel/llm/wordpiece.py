"""Token counts: greedy longest-match word pieces in linear time.

The vocabulary is a trie with failure links; each node knows how many pieces
its failure pops.  Following links gives the number of pieces of a word
without building them.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.llm.shingles import SPACE, buffers, chunks, word_hashes, word_spans
from caravel.llm.store import lean, tidy
from caravel.llm.tokens import TOKENIZER, place

NONE = -1
#: Longer words are matched one by one, not together.
TOGETHER = 64


class Automaton:
    """``first``: pieces that begin a word; ``inner``: pieces that continue one (bytes)."""

    def __init__(self, first: Iterable[bytes], inner: Iterable[bytes]) -> None:
        kids: list[dict[int, int]] = [{}, {}]  # node 0: start of a word, node 1: behind a piece
        piece = [False, False]
        for root, pieces in ((0, first), (1, inner)):
            for p in pieces:
                x = root
                for c in p:
                    if c not in kids[x]:
                        kids[x][c] = len(kids)
                        kids.append({})
                        piece.append(False)
                    x = kids[x][c]
                if x != root:
                    piece[x] = True
        fail, pops = [NONE] * len(kids), [0] * len(kids)
        queue = deque([0, 1])
        while queue:
            x = queue.popleft()
            for c, y in kids[x].items():
                if piece[y]:
                    fail[y], pops[y] = 1, 1
                else:
                    z, n = fail[x], pops[x]
                    while z != NONE and c not in kids[z]:
                        n += pops[z]
                        z = fail[z]
                    if z != NONE:
                        fail[y], pops[y] = kids[z][c], n
                queue.append(y)
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        edges = sorted((x << 8 | c, y) for x, k in enumerate(kids) for c, y in k.items())
        self.keys, self.to = (np.array([e[i] for e in edges], t) for i, t in ((0, np.int64), (1, np.int32)))

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], NONE)

    def counts(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of pieces of each word; 0 if the vocabulary can't spell it."""
        size = end - start
        out = np.zeros(len(start), np.int64)
        for i in np.flatnonzero(size > TOGETHER).tolist():
            out[i] = self.count(text[start[i] : end[i]].tolist())
        live = np.flatnonzero(size <= TOGETHER)
        live = live[np.argsort(-size[live], kind="stable")]
        if not len(live) or not len(self.keys):
            return out
        node, n = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        length, begin = size[live], start[live]
        for j in range(int(length[0])):
            width = int(np.searchsorted(-length, -j, "left"))  # words longer than j
            todo = np.flatnonzero(node[:width] != NONE)
            while len(todo):
                to = self.step(node[todo], text[begin[todo] + j])
                stuck = to == NONE
                node[todo[~stuck]] = to[~stuck]
                todo = todo[stuck]
                n[todo] += self.pops[node[todo]]
                node[todo] = self.fail[node[todo]]
                todo = todo[node[todo] != NONE]
        todo = np.flatnonzero((node != NONE) & (node != 1))
        while len(todo):
            n[todo] += self.pops[node[todo]]
            node[todo] = self.fail[node[todo]]
            todo = todo[(node[todo] != NONE) & (node[todo] != 1)]
        out[live] = np.where(node == 1, n, 0)
        return out

    def count(self, word: list[int]) -> int:
        if not hasattr(self, "_kids"):
            self._kids = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True))
            self._fail, self._pops = self.fail.tolist(), self.pops.tolist()
        x = n = 0
        for c in word:
            while (y := self._kids.get(x << 8 | c, NONE)) == NONE:
                n += self._pops[x]
                x = self._fail[x]
                if x == NONE:
                    return 0
            x = y
        while x != 1:
            n += self._pops[x]
            x = self._fail[x]
            if x == NONE:
                return 0
        return n


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary(path: str | None = None) -> tuple[list[bytes], list[bytes]]:
    """(first, inner) pieces from a byte-level vocabulary: those behind a space begin words, the others continue them."""
    with open(path or place(TOKENIZER), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    table = byte_alphabet()
    found = [bytes(table[c] for c in t) for t in vocab if all(c in table for c in t)]
    return [p[1:] for p in found if p[:1] == b" " and len(p) > 1], [p for p in found if b" " not in p]


def piece_counts(docs: DataFrame, text: str, pieces: tuple[list[bytes], list[bytes]] | None = None) -> DataFrame:
    """``docs`` with n_words, n_tokens and n_unknown of each whole text.

    Words are separated by white space.  A word that the vocabulary can't spell
    is one unknown token.  Null and empty texts have none.
    """
    shared = lean(docs.sparkSession).sparkContext.broadcast(Automaton(*(pieces or vocabulary())))
    keep = [c for c in docs.columns if c not in ("n_words", "n_tokens", "n_unknown")]
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            words, tokens, unknown = [], [], []
            off, data = buffers(batch.column(at))
            for i, j in chunks(off, 1 << 21):
                own = off[i : j + 1] - off[i]
                part = data[off[i] : off[j]]
                start, end = word_spans(part, own, SPACE)
                _, example, which = np.unique(word_hashes(part, start, end), return_index=True, return_inverse=True)
                n = machine.counts(part, start[example], end[example])[which]
                for total, value in ((words, np.ones(len(n), np.int64)), (tokens, np.maximum(n, 1)), (unknown, (n == 0).astype(np.int64))):
                    sums = np.concatenate([[0], np.cumsum(value)])
                    total.append(np.diff(sums[np.searchsorted(start, own)]))
            columns = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (words, tokens, unknown)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*keep, "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(*keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(tidy(run), f"{fields}, n_words long, n_tokens long, n_unknown long")

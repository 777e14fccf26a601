"""Vectorised word and shingle hashing over Arrow string buffers.

Everything works on the UTF-8 bytes of a whole Arrow batch at a time, so no
Python object is made per word.  A word is a run of bytes that are not in the
given separator class, with ``A-Z`` lower-cased; every byte of a multi-byte
character counts as part of a word.  Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: Values of bytes as they are; in ``_BYTE`` A-Z have those of a-z.
EXACT = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_STEP = U(0x9E3779B97F4A7C15)

#: Separators: space and the control characters from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Text handled at once; bounds the working memory of a task.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | U(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def word_spans(text: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; the texts' ends in ``off`` also end words."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = ~separators[text]
    cut = np.zeros(len(text) + 1, bool)
    cut[1:-1] = w[1:] != w[:-1]
    cut[off] = True
    cut[0] = cut[-1] = True
    edge = np.flatnonzero(cut)
    inside = w[edge[:-1]]
    return edge[:-1][inside], edge[1:][inside]


#: Texts up to this size are hashed by running sums; longer ones word by word, in less memory.
_RUN = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the step, and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) <= n:
        size = 1 << n.bit_length()
        back = U(pow(int(_STEP), -1, 1 << 64))
        for name, x in (("up", _STEP), ("down", back)):
            _POWERS[name] = np.cumprod(np.append(U(1), np.full(size, x)))
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Polynomial hash of the bytes of each word; with ``EXACT`` as ``values`` case counts."""
    if not len(start):
        return np.zeros(0, np.uint64)
    if len(text) <= _RUN:
        up, down = _powers(len(text) + 1)
        run = np.zeros(len(text) + 1, np.uint64)
        value = values[text]
        value *= up[: len(text)]
        np.cumsum(value, out=run[1:])
        return mix((run[end] - run[start]) * down[start] * _STEP)
    size = end - start
    last = np.cumsum(size)
    first = last - size
    at = np.arange(int(last[-1]))
    inner = at - np.repeat(first, size)
    power = np.cumprod(np.full(int(size.max()), _STEP))
    value = values[text[inner + np.repeat(start, size)]]
    value *= power[inner]
    return mix(np.add.reduceat(value, first))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i .. i+k-1 for every i that has them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _PLACE[0]
    for i in range(1, k):
        total += words[i : n + i] * _PLACE[i]
    return mix(total)


def short_hash(words: np.ndarray) -> np.ndarray:
    """Hash of a sequence of fewer words than a shingle has."""
    total = U(len(words))
    with np.errstate(over="ignore"):
        for w, p in zip(words, _PLACE, strict=False):
            total = total + w * p
    return mix(np.array([total], np.uint64) * U(0xA24BAED4963EE407))


def short_hashes(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``short_hash`` of several sequences: ``n`` words, at least one, from ``first`` on."""
    if not len(first):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(n)
    inner = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
    own = words[inner + np.repeat(first, n)] * _PLACE[inner]
    return mix((np.add.reduceat(own, ends - n) + n.astype(np.uint64)) * U(0xA24BAED4963EE407))


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes, one text at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def shingle_sets(column: pa.Array, k: int, separators: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a string column.

    With fewer than ``k`` words the whole sequence is the only shingle; a text
    without words has an empty set.
    """
    off, data = buffers(column)
    for i, j in chunks(off):
        own = off[i : j + 1] - off[i]
        text = data[off[i] : off[j]]
        start, end = word_spans(text, own, separators)
        words = word_hashes(text, start, end)
        first = np.searchsorted(start, own)
        shingles = shingle_hashes(words, k)
        for row, a, b in zip(range(i, j), first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(shingles[a : b - k + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield row, s[keep]
            elif b > a:
                yield row, short_hash(words[a:b])
            else:
                yield row, np.zeros(0, np.uint64)


def packed_sets(column: pa.Array, k: int, separators: np.ndarray = SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first token of each, tokens): ``shingle_sets`` of the rows with words, some at a time; for many short texts."""
    off, data = buffers(column)
    for i, j in chunks(off):
        own = off[i : j + 1] - off[i]
        text = data[off[i] : off[j]]
        start, end = word_spans(text, own, separators)
        if not len(start):
            continue
        first = np.searchsorted(start, own)
        count = np.diff(first)
        h = word_hashes(text, start, end)
        s = shingle_hashes(h, k)
        live = np.flatnonzero(count)
        short = count[live] < k
        a, n = first[:-1][live], np.maximum(count[live] - k + 1, 1)
        ends = np.cumsum(n)
        begin = ends - n
        at = np.arange(int(ends[-1])) + np.repeat(a - begin, n)
        # what short texts take here is replaced
        s = s[np.minimum(at, len(s) - 1)] if len(s) else np.zeros(len(at), np.uint64)
        s[begin[short]] = short_hashes(h, a[short], count[live][short])
        for x, y in zip(begin[n > 1].tolist(), ends[n > 1].tolist(), strict=True):
            s[x:y].sort()
        fresh = np.append(True, s[1:] != s[:-1])
        fresh[begin] = True
        place = np.cumsum(fresh) - 1
        yield live + i, place[begin], s[fresh]

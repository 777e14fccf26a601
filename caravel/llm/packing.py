"""Packing of tokenised documents into sequences of a fixed length.

Two ways.  ``pattern_pack`` plans the whole corpus from its histogram of piece
lengths: few-document patterns that fill a sequence, repeat counts by
non-negative least squares, rounding, and best fit for what is left.
``best_fit_pack`` packs blocks of pieces inside each task and makes the id
matrices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caravel.llm.store import lean, settle, tidy
from caravel.llm.tokens import RANKS, TOKENIZER, cut, encode, place

END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, doc: str, text: str, size: int, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut into pieces."""
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = tokenizer or place(TOKENIZER), ranks or place(RANKS)  # found where the task runs
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(t.as_py() or "", *files), np.uint32(END)).astype("<u4")
                for i, (start, length) in enumerate(cut(len(ids), size)):
                    for column, value in zip(out, (d, i, start, length, zlib.crc32(ids[start : start + length])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc).cast("long").alias("doc_id"), text).mapInArrow(tidy(run), PIECES)


def patterns(size: int, step: int) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to ``size``: all pairs, and triples whose least length is a multiple of ``step``."""
    a = np.arange(1, size // 2 + 1)
    found = [np.stack([size - a, a, np.zeros_like(a)], axis=1)]
    for c in range(step, size // 3 + 1, step):
        b = np.arange(c, (size - c) // 2 + 1)
        found.append(np.stack([size - c - b, b, np.full_like(b, c)], axis=1))
    return np.concatenate(found)


def fit_counts(shapes: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise |A x - histogram|, by accelerated projected gradients."""
    n, m = len(shapes), len(histogram)
    flat = shapes.ravel()
    degree = np.bincount(flat, minlength=m).astype(float)
    degree[0] = 0
    # the largest eigenvalue of A'A is at most the largest sum of a row of it
    bound = float(degree[flat].reshape(shapes.shape).sum(axis=1).max()) or 1.0
    x = np.zeros(n)
    y, t = x, 1.0
    for _ in range(rounds):
        made = np.bincount(flat, np.repeat(y, shapes.shape[1]), minlength=m)
        gap = made - histogram
        gap[0] = 0
        new = np.maximum(0, y - gap[flat].reshape(shapes.shape).sum(axis=1) / bound)
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / ahead * (new - x)
        x, t = new, ahead
    return x


def best_fit(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing over a histogram: (lengths of a sequence, how many such sequences)."""
    room: list[list[list]] = [[] for _ in range(size + 1)]  # by what is free: [lengths, count]
    for length in range(len(histogram) - 1, 0, -1):
        left = int(histogram[length])
        free = length
        fresh: list[tuple[int, list]] = []
        while left and free <= size:
            if not room[free]:
                free += 1
                continue
            kind = room[free][-1]
            n = min(left, kind[1])
            left -= n
            kind[1] -= n
            if not kind[1]:
                room[free].pop()
            new = [(*kind[0], length), n]
            if free - length >= length:  # one more of this length fits, and best there
                free -= length
                room[free].append(new)
            else:
                fresh.append((free - length, new))
        if left:
            many = size // length
            if left // many:
                fresh.append((size - many * length, [(length,) * many, left // many]))
            if left % many:
                fresh.append((size - left % many * length, [(length,) * (left % many), 1]))
        for free, new in fresh:
            room[free].append(new)
    return [(tuple(k[0]), k[1]) for kinds in room for k in kinds]


def plan(histogram: np.ndarray, size: int, step: int = 8) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for a histogram of lengths 0 .. size, as (lengths, count), together exactly the histogram."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    done: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        done.append(((size,), int(left[size])))
        left[size] = 0
    shapes = patterns(size, step)
    shapes = shapes[((left[shapes] > 0) | (shapes == 0)).all(axis=1)]
    if len(shapes):
        x = fit_counts(shapes, left.astype(float))
        for i in np.argsort(-x, kind="stable").tolist():
            if x[i] < 0.5:
                break
            own = [int(v) for v in shapes[i] if v]
            n = min(int(round(x[i])), *(int(left[v]) // own.count(v) for v in own))
            if n > 0:
                for v in own:
                    left[v] -= n
                done.append((tuple(own), n))
    return done + best_fit(left, size)


def slots(kinds: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length the ranks that each place of each pattern takes, sorted by (length, rank)."""
    used: dict[int, int] = {}
    rows = []
    base = 0
    for lengths, n in kinds:
        at = 0
        for v in lengths:
            rank = used.get(v, 0)
            rows.append((v, rank, base, at))
            used[v] = rank + n
            at += v
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "base", "offset"), table.T.copy(), strict=True))


def pattern_pack(rows: DataFrame, size: int, step: int = 8) -> DataFrame:
    """``rows`` (with doc_id, piece and length) and the sequence_id and offset of each.

    Only the histogram (``size`` numbers) and the plan, whose size the number
    of patterns bounds, pass through the driver.  Equal lengths are numbered
    in buckets, so a length that a third of all pieces have is spread.
    An empty table gives an empty result.
    """
    rows = settle(rows)
    counted = rows.groupBy("length").count().collect()
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counted:
        histogram[length] = n
    table = slots(plan(histogram, size, step))
    buckets = max(16, int(histogram.sum()) // 20_000)
    order = ["doc_id", "piece", "start", "ids_crc32"] if {"start", "ids_crc32"} <= set(rows.columns) else ["doc_id", "piece"]
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = settle(sums.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    own = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_rn", F.row_number().over(own)).join(sums, ["length", "_bucket"])
    ranked = ranked.withColumn("sequence_id", F.col("_before") + F.col("_rn") - 1).withColumn("offset", F.col("length")).select(*rows.columns, "sequence_id", "offset")
    shared = rows.sparkSession.sparkContext.broadcast(table)
    names = ranked.columns
    at_length, at_rank = names.index("length"), names.index("sequence_id")

    def place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = t["length"] << 40 | t["rank"]
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            i = np.searchsorted(key, length << 40 | rank, "right") - 1
            columns = batch.columns[:at_rank] + [pa.array(t["base"][i] + rank - t["rank"][i]), pa.array(t["offset"][i])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return ranked.mapInArrow(tidy(place_rows), ranked.schema)


class Capacities:
    """Segment tree over free space: which is the least of at least a given size?"""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, n: int) -> None:
        i = free + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, free: int) -> int | None:
        """The least occupied capacity >= free."""
        i = free + self.leaves
        if self.count[i]:
            return free
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Indexes of the lengths in each sequence; longest first, each into the fullest sequence with room."""
    tree = Capacities(size)
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        free = tree.least(lengths[i])
        if free is None:
            out.append([])
            which, free = len(out) - 1, size
        else:
            which = open_[free].pop()
            tree.add(free, -1)
        out[which].append(i)
        left = free - lengths[i]
        if left:
            open_[left].append(which)
            tree.add(left, 1)
    return out


PACKED = "sequence_id long, doc_ids array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


def best_fit_pack(docs: DataFrame, doc: str, text: str, size: int, block: int = 8192, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """Packed sequences: rows of an id matrix, cumulative segment lengths and position resets; see ``PACKED``.

    Each task packs its pieces in blocks of ``block``; nothing is shuffled.  So
    which pieces share a sequence depends on how the table is partitioned;
    the pieces and their ids don't.  ``input_ids`` and ``position_ids`` are
    ``size`` unsigned 32-bit numbers, little-endian: the segments' ids in order
    and their places, which start at 0 in each segment; behind
    ``cu_seqlens``' last number all are 0.  Null texts count as empty; each
    document ends with the end id, so it has one token at least.  A null doc
    id stays null; repeated rows are packed each.  An empty table gives none.
    """
    lean(docs.sparkSession)

    def matrix(rows: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * (4 * size)), pa.py_buffer(np.ascontiguousarray(rows))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = tokenizer or place(TOKENIZER), ranks or place(RANKS)
        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            packed = best_fit_decreasing([len(h[3]) for h in held], size)
            for at in range(0, len(packed), 512):
                own = packed[at : at + 512]
                ids, positions = np.zeros((len(own), size), "<u4"), np.zeros((len(own), size), "<u4")
                lists: list[list] = [[], [], [], []]
                for i, members in enumerate(own):
                    parts = [held[m] for m in members]
                    bounds = np.cumsum([0, *(len(p[3]) for p in parts)])
                    ids[i, : bounds[-1]] = np.concatenate([p[3] for p in parts])
                    positions[i, : bounds[-1]] = np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))
                    for column, value in zip(lists, ([p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts], bounds.tolist()), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
                columns = [pa.array(np.arange(number, number + len(own))), *(pa.array(c, pa.list_(k)) for c, k in zip(lists, kinds, strict=True)), matrix(ids), matrix(positions)]
                number += len(own)
                yield pa.RecordBatch.from_arrays(columns, names=["sequence_id", "doc_ids", "pieces", "starts", "cu_seqlens", "input_ids", "position_ids"])

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(t.as_py() or "", *files), np.uint32(END))
                held += [(d, i, start, ids[start : start + n]) for i, (start, n) in enumerate(cut(len(ids), size))]
                if len(held) >= block:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    return docs.select(F.col(doc).cast("long"), text).mapInArrow(tidy(run), PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """``packed`` as Parquet files in a folder that must not exist: each has rows of equal width, so its id column is a matrix."""
    packed.write.option("compression", "zstd").parquet(path)


def read_packed(spark, path: str) -> DataFrame:
    """What ``write_packed`` wrote, with the ids and positions that are in use as arrays of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used = np.array([c[-1] for c in batch.column("cu_seqlens").to_pylist()], np.int32)
            out = batch.columns[:5]
            for name in ("input_ids", "position_ids"):
                rows = [np.frombuffer(x, "<u4", n) for x, n in zip(batch.column(name).to_pylist(), used.tolist(), strict=True)]
                values = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
                out.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(used)).astype(np.int32), values))
            yield pa.RecordBatch.from_arrays(out, names=batch.schema.names)

    return lean(spark).read.parquet(path).mapInArrow(tidy(run), PACKED.replace("binary", "array<int>"))

"""Exact set-similarity join at scale: prefix candidates, clusters, trie join.

The sets are the distinct word shingles of texts (or of their lines).  Two
sets link when ``den * |A & B| >= num * |A | B|``.  Steps:

1. ``heavy_shingles``: the shingles that repeat most, a list of bounded size.
   It only shapes the common order (rare first, then by hash), so its bound
   costs no result.
2. ``describe``: per text or line its set's 127-bit digest, size, prefix in
   the common order and a parity sketch; equal sets become one *class*.
3. ``edges_of``: prefix tokens meet in buckets, as packed arrays, a bucket at
   a time.  Pairs of classes pass length and positional bounds and the
   sketches' bound on the symmetric difference.  In blocks above ``BLOCK`` no
   pairs are formed: all members are tested against the block's leader by
   their sketches, and those that fail against the rest of its members, in
   groups of bounded size (``leader_edges``).  No edge stands untested.
4. Connected components of these edges are the clusters: no link crosses two.
   Each class's set is sent to its cluster once, where ``trie`` joins it.
   Clusters above ``CLUSTER`` are split: chunks that share pivots first, then
   only what is still undecided against every chunk.

A text is known by ``doc`` and ``row``, a hash of its doc id and the text, so
repeated ids are told apart.  Hashes of shingles have 64 bits, digests of sets
127; within these the join is exact and no partner or candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.llm.components import Forest, connected_components
from caravel.llm.shingles import SPACE, U, buffers, mix, packed_sets, shingle_sets
from caravel.llm.store import holds, key_filter, lean, partitions, settle, tidy
from caravel.llm.trie import linked_components, linked_to_earlier

#: Largest block of a prefix token in which pairs are formed.
BLOCK = 64
#: Largest number of sets, and of their tokens on average, joined by one trie.
CLUSTER, CLUSTER_TOKENS = 512, 1_000_000
#: Shingles that a task holds while it counts.
FLUSH = 1_000_000
#: Most shingles in the list that shapes the order.
HEAVY = 100_000
#: Prefix tokens of a bucket, on average: what a task holds at once, also before it deals them out.
BUCKET = 400_000
#: Buckets' blobs in an Arrow batch.
BLOBS = 1000
#: Buckets that a task takes one by one; more data bring more tasks.
TASK_BUCKETS = 12
#: Members and undecided classes of a leader that one group compares by sketches.
MEMBERS, UNDECIDED = 4096, 512
PIVOTS = 8


def least_overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The smallest intersection that a set of size n can have with a linked one."""
    return -(-n * num // den)


def units(column: pa.Array, by_line: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts whose sets are taken: (strings, row, line number); lines end at a newline byte."""
    if not by_line:
        return column, np.arange(len(column)), np.zeros(len(column), np.int64)
    off, data = buffers(column)
    lo, hi = off[0], off[-1]
    feeds = np.flatnonzero(data[lo:hi] == 10) + lo
    # a line starts at each text's start and behind each newline in it
    starts = np.concatenate([off[:-1], feeds + 1])
    rows = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, feeds, "right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.append(starts[1:], hi)
    changes = np.append(rows[1:] != rows[:-1], True)
    ends = np.where(changes, off[1:][rows], ends - 1)
    number = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    # spans are contiguous but for the newlines, which are separators: keep them at the line's end
    bounds = np.append(starts, hi)
    text = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(data)])
    return text, rows, number


def digest(s: np.ndarray) -> tuple[int, int]:
    a, b = digest_many(s, np.zeros(1, np.int64), np.array([len(s)]))
    return int(a[0]), int(b[0])


def digest_many(tokens: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``digest`` of the sets that begin at ``first`` and have ``n`` tokens: 63 bits, never negative, and 64."""
    a = mix(np.bitwise_xor.reduceat(mix(tokens + U(1)), first) ^ n.astype(np.uint64))
    b = mix(np.add.reduceat(mix(tokens ^ U(0x5851F42D4C957F2D)), first))
    return (a >> U(1)).view(np.int64), b.view(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Parity of the tokens in each of about n/2 cells, a power of two."""
    bits = 1 << max(6, int(len(s) // 2 - 1).bit_length() if len(s) > 2 else 6)
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """At most the symmetric difference of the two sets."""
    x, y = (np.frombuffer(v, np.uint8) for v in sorted((a, b), key=len))
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def heavy_shingles(docs: DataFrame, text: str, k: int, separators: np.ndarray = SPACE, by_line: bool = False, limit: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, their counts) of the shingles that repeat most within tasks.

    Every text is counted.  A task reports what it sees twice or more, so a
    count may fall short by what tasks see once; the list is bounded by
    ``limit`` and shapes only the order of tokens.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                every = np.sort(np.concatenate(held))
                cut = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
                n = np.diff(np.append(cut, len(every)))
                many = n >= 2
                yield pa.RecordBatch.from_arrays([pa.array(every[cut[many]].view(np.int64)), pa.array(n[many])], names=["token", "n"])

        for batch in batches:
            column, _, _ = units(batch.column(0), by_line)
            for _, s in shingle_sets(column, k, separators):
                held.append(s)
                size += len(s)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        yield from flush()

    lean(docs.sparkSession)
    return top_shingles(docs.select(text).mapInArrow(tidy(count), "token long, n long"), limit)


def top_shingles(counts: DataFrame, limit: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, their sums) of the ``limit`` tokens of the largest sums."""
    rows = counts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(limit).toArrow()
    tokens = rows["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows["n"].to_numpy()[order]


def in_order(s: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """The first ``length`` tokens of a sorted set in the common order: rare first, then by hash."""
    tokens, counts = heavy
    if not len(tokens):
        return s[:length]
    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
    known = tokens[at] == s
    light = s[~known]
    if len(light) >= length:
        return light[:length]
    dense = s[known]
    dense = dense[np.lexsort((dense, counts[at[known]]))]
    return np.concatenate([light, dense[: length - len(light)]])


DESCRIBED = "doc long, row long, line int, n int, id long, id2 long, prefix binary, sketch binary"


def describe(docs: DataFrame, doc: str, text: str, k: int, num: int, den: int, heavy, separators: np.ndarray = SPACE, by_line: bool = False) -> DataFrame:
    """One row for each text or line that has a set; see ``DESCRIBED``.

    Texts with empty sets are given too (n = 0) unless ``by_line``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            column, rows, number = units(batch.column(2), by_line)
            at, n, a, b, prefix, marks = [], [], [], [], [], []
            for u, s in shingle_sets(column, k, separators):
                if not len(s):
                    if by_line:
                        continue
                    x = (0, 0)
                    p = m = b""
                else:
                    x = digest(s)
                    p = in_order(s, order, len(s) - int(least_overlap(len(s), num, den)) + 1).tobytes()
                    m = sketch(s)
                at.append(u)
                n.append(len(s))
                a.append(x[0])
                b.append(x[1])
                prefix.append(p)
                marks.append(m)
            at = np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(rows[at])) for i in (0, 1)), pa.array(number[at], pa.int32()), pa.array(n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(prefix, pa.binary()), pa.array(marks, pa.binary())],
                names=["doc", "row", "line", "n", "id", "id2", "prefix", "sketch"],
            )

    return keyed(docs, doc, text).mapInArrow(tidy(run), DESCRIBED)


def row_key(doc: str, text: str) -> Column:
    """A hash that tells rows of one doc id with different texts apart."""
    return F.xxhash64(F.col(doc).cast("long"), text)


def keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, row, text) of ``docs``."""
    return docs.select(F.col(doc).cast("long").alias("doc"), row_key(doc, text).alias("row"), F.col(text).alias("text"))


def classes(described: DataFrame) -> DataFrame:
    """One row for each distinct non-empty set, with its first (doc, row, line)."""
    first = F.min(F.struct("doc", "row", "line", "prefix", "sketch", "n")).alias("x")
    return described.filter("n > 0 and doc is not null").groupBy("id", "id2").agg(first).select("id", "id2", *[F.col(f"x.{c}").alias(c) for c in ("doc", "row", "line", "n", "prefix", "sketch")])


_REST = [("id", "<i8"), ("n", "<u2"), ("pos", "<u2")]
_ROW = np.dtype([("token", "<u4"), *_REST])
_WHOLE = np.dtype([("token", "<u8"), *_REST])
_FAR = 0xFFFF


def candidate_edges(cls: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) edges over class ids such that linked classes are connected."""
    return edges_of(cls.select("id", "n", "prefix"), cls, num, den)


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a), pa.int64()), pa.array(np.ascontiguousarray(b), pa.int64())], names=["a", "b"])


def _pairs(rows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of ids within small blocks that pass the bounds, (id, leader) of large blocks' members), each distinct."""
    rows = rows[np.lexsort((rows["id"], rows["token"]))]
    if len(rows) > 1:
        again = (rows["token"][1:] == rows["token"][:-1]) & (rows["id"][1:] == rows["id"][:-1])
        rows = rows[np.append(True, ~again)]
    cut = np.flatnonzero(np.append(True, rows["token"][1:] != rows["token"][:-1]))
    size = np.diff(np.append(cut, len(rows)))
    of = np.repeat(np.arange(len(cut)), size)
    leader = rows["id"][cut][of]  # ids rise within a block
    large = (size > BLOCK)[of]
    led = np.unique(np.stack([rows["id"][large], leader[large]], axis=1), axis=0)
    keep = ~large & (size > 1)[of]
    rows, size, start = rows[keep], size[of][keep], cut[of][keep]
    left = start + size - np.flatnonzero(keep) - 1  # partners behind
    ids, n, pos = rows["id"], rows["n"].astype(np.int64), rows["pos"].astype(np.int64)
    found = [np.zeros((0, 2), np.int64)]
    for step in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(left >= step)
        j = i + step
        ni, nj = n[i], n[j]
        small, big = np.minimum(ni, nj), np.maximum(ni, nj)
        free = big >= _FAR
        ok = free | (small * den >= big * num)
        most = 1 + np.minimum(ni - pos[i] - 1, nj - pos[j] - 1)
        # overlap of a linked pair: at least num * (ni + nj) / (den + num)
        ok &= free | (most * (den + num) >= num * (ni + nj))
        i, j = i[ok], j[ok]
        if len(i):
            found.append(np.stack([ids[i], ids[j]], axis=1))
    return np.unique(np.concatenate(found), axis=0), led


def dealt_tokens(batches: Iterator[pa.RecordBatch], buckets: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(bucket, blob of ``_ROW``) of (id, n, prefix), ``BUCKET`` tokens at a time.

    Dealt by batch, rows would grow as batches times buckets, with the square of the corpus.
    """
    held: list[np.ndarray] = []  # tokens are whole, as they tell the bucket

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        every = np.concatenate(held)
        place = every["token"] % U(buckets)
        if buckets < 1 << 16:
            place = place.astype(np.uint16)  # sorted by radix
        order = np.argsort(place, kind="stable")
        every, place = every[order], place[order].astype(np.int64)
        rows = np.empty(len(every), _ROW)
        rows["token"] = every["token"] >> U(32)
        for c, _ in _REST:
            rows[c] = every[c]
        cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        ends = np.append(cut[1:], len(rows))
        for i in range(0, len(cut), BLOBS):
            a, b = cut[i : i + BLOBS], ends[i : i + BLOBS]
            bounds = (np.append(a, b[-1]) - a[0]) * _ROW.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(rows[a[0] : b[-1]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(place[a]), blobs], names=["bucket", "blob"])

    for batch in batches:
        ids, size = (batch.column(i).to_numpy() for i in (0, 1))
        able = den * size.astype(np.int64) >= num * (size.astype(np.int64) + 1)
        if not able.any():
            continue
        if not able.all():
            batch, ids, size = batch.filter(pa.array(able)), ids[able], size[able]
        blobs = batch.column(2)
        bounds = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4)
        token = np.frombuffer(blobs.buffers()[2], np.uint64, (bounds[-1] - bounds[0]) // 8, bounds[0])
        count = np.diff(bounds) // 8
        owner = np.repeat(np.arange(len(ids)), count)
        pos = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
        rows = np.empty(len(token), _WHOLE)
        rows["token"], rows["id"] = token, ids[owner]
        rows["n"], rows["pos"] = np.minimum(size[owner], _FAR), np.minimum(pos, _FAR)
        held.append(rows)
        if sum(map(len, held)) >= BUCKET:
            yield from flush()
            held.clear()
    yield from flush()


def edges_of(source: DataFrame, cls: DataFrame, num: int, den: int, make=lambda batches: batches) -> DataFrame:
    """``candidate_edges`` of the (id, n, prefix) batches that ``make`` gives of the source's; rows may repeat.  ``cls`` has id, n and sketch.

    Sets so small that only equal ones link with them bring no rows.  There are
    as many buckets as keep one to ``BUCKET`` tokens on average, several to a
    partition; a task holds one at a time.
    """
    spark = cls.sparkSession
    alone = F.lit(den) * F.col("n") < F.lit(num) * (F.col("n") + 1)
    marks = cls.filter(~alone).select("id", "n", "sketch")
    tokens = marks.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    buckets = max(partitions(spark), -(-tokens // BUCKET))
    tasks = max(partitions(spark), -(-buckets // TASK_BUCKETS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from dealt_tokens(make(batches), buckets, num, den)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _grouped(batches, 1):
            pairs, led = _pairs(np.frombuffer(b"".join(x[0] for x in blobs), _ROW), num, den)
            for both, is_led in ((pairs, False), (led, True)):
                for i in range(0, len(both), 50_000):
                    own = both[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([*_edges(own[:, 0], own[:, 1]).columns, pa.array(np.full(len(own), is_led))], names=["a", "b", "led"])

    dealt = source.mapInArrow(tidy(deal), "bucket long, blob binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    met = settle(dealt.mapInArrow(tidy(meet), "a long, b long, led boolean"))
    pairs = met.distinct().join(marks.toDF("a", "na", "sa"), "a").join(marks.toDF("b", "nb", "sb"), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, led, na, sa, nb, sb = batch.columns
            x, y = sa.to_pylist(), sb.to_pylist()
            own, other = na.to_numpy().astype(np.int64), nb.to_numpy().astype(np.int64)
            keep = np.zeros(len(own), bool)
            small = np.array([len(u) == len(v) == 8 for u, v in zip(x, y, strict=True)], bool)
            words = [np.frombuffer(b"".join(v[i] for i in np.flatnonzero(small)), "<u8") for v in (x, y)]
            allowed = most_apart(own, other, num, den)
            keep[small] = np.bitwise_count(words[0] ^ words[1]) <= allowed[small]
            for i in np.flatnonzero(~small).tolist():
                keep[i] = sketch_distance(x[i], y[i]) <= allowed[i]
            yield pa.RecordBatch.from_arrays([a, b, led, pa.array(keep)], names=["a", "b", "led", "near"])

    tested = settle(pairs.select("a", "b", "led", "na", "sa", "nb", "sb").mapInArrow(tidy(near), "a long, b long, led boolean, near boolean").filter("led or near"))
    return tested.filter("near").select("a", "b").unionByName(leader_edges(tested.filter("led").select("a", "b", "near"), marks, num, den))


def most_apart(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of n and m tokens; negative where their sizes rule a link out."""
    least = -(-num * (n + m) // (den + num))
    fits = np.minimum(n, m) * den >= np.maximum(n, m) * num
    return np.where(fits, n + m - 2 * least, -1)


def leader_edges(led: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) edges that connect what a leader's members (a, b = leader, near) leave undecided.

    Members near their leader are connected to it already.  Each that isn't is
    compared, by sketches, with every member of its leader; a group holds
    ``UNDECIDED`` of them and ``MEMBERS`` members, and gives no more edges
    than join its components.
    """
    counts = led.groupBy("b").agg(F.count("*").alias("m"), F.count_if(~F.col("near")).alias("r")).filter("r > 0")
    counts = settle(counts.select("b", F.ceil(F.col("m") / MEMBERS).cast("int").alias("parts"), F.ceil(F.col("r") / UNDECIDED).cast("int").alias("parts2")))
    if counts.isEmpty():
        return led.select("a", "b").limit(0)
    known = led.join(counts, "b").join(marks.withColumnRenamed("id", "a"), "a")
    salt = lambda parts: F.pmod(F.xxhash64("a"), F.col(parts)).cast("int")
    place = lambda part, part2, asks: F.struct(part.alias("part"), part2.alias("part2"), F.lit(asks).alias("asks"))
    member = F.transform(F.sequence(F.lit(0), F.col("parts2") - 1), lambda i: place(salt("parts"), i, False))
    asking = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: place(i, salt("parts2"), True))
    places = F.when(F.col("near"), member).otherwise(F.concat(member, asking))
    keys = ["b", "part", "part2"]
    rows = known.select("b", "a", "n", "sketch", "near", F.explode(places).alias("x")).select("b", "x.part", "x.part2", "a", "n", "sketch", "near", "x.asks")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (leader, _, _), group in _grouped(batches, 3):
            forest = Forest()
            a, b = [], []
            by_length: dict[int, list] = {}
            for x, n, mark, near, asks in group:
                if not asks:
                    by_length.setdefault(len(mark), []).append((x, n, mark))
                    if near:
                        forest.union(x, leader)
            packed = [(size, np.array([r[0] for r in v]), np.array([r[1] for r in v], np.int64), np.frombuffer(b"".join(r[2] for r in v), "<u8").reshape(len(v), -1)) for size, v in by_length.items()]
            for x, n, mark, _, asks in group:
                if not asks:
                    continue
                for size, ids, sizes, words in packed:
                    allowed = most_apart(np.int64(n), sizes, num, den)
                    if not (allowed >= 0).any():
                        continue
                    own = np.frombuffer(mark, "<u8")
                    if size > len(mark):
                        words = np.bitwise_xor.reduce(words.reshape(len(words), -1, len(own)), axis=1)
                    elif size < len(mark):
                        own = np.bitwise_xor.reduce(own.reshape(-1, size // 8), axis=0)
                    hit = np.bitwise_count(words ^ own).sum(axis=1, dtype=np.int64) <= allowed
                    for y in ids[hit].tolist():
                        if forest.union(x, y):
                            a.append(x)
                            b.append(y)
            yield _edges(np.array(a, np.int64), np.array(b, np.int64))

    return settle(rows.mapInArrow(tidy(compare), "a long, b long"))


def _cells(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(row.astype(np.int64).view(np.uint64) ^ mix(line.astype(np.int64).view(np.uint64))).view(np.int64)


def place_filter(places: DataFrame) -> np.ndarray:
    """Key filter over (row, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_cells(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], names=["at"])

    return key_filter(places.select("row", "line").mapInArrow(tidy(run), "at long"))


def with_sets(docs: DataFrame, doc: str, text: str, k: int, members: DataFrame, separators: np.ndarray = SPACE, by_line: bool = False) -> DataFrame:
    """``members`` (id, id2, doc, row, line, ...) with the shingles of their texts as packed ``tokens``."""
    bits = docs.sparkSession.sparkContext.broadcast(place_filter(members))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, rows, number = units(batch.column(2), by_line)
            which = np.flatnonzero(holds(bits.value, _cells(batch.column(1).to_numpy()[rows], number)))
            if not len(which):
                continue
            for sets, first, tokens in packed_sets(column.take(pa.array(which)), k, separators):
                n = np.diff(np.append(first, len(tokens)))
                a, b = digest_many(tokens, first, n)
                at = which[sets]
                blobs = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(first, len(tokens)).astype(np.int64) * 8), pa.py_buffer(tokens)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(batch.column(i).take(pa.array(rows[at])) for i in (0, 1)), pa.array(number[at], pa.int32()), blobs], names=["id", "id2", "doc", "row", "line", "tokens"])

    found = keyed(docs, doc, text).mapInArrow(tidy(run), "id long, id2 long, doc long, row long, line int, tokens binary")
    return members.join(found.dropDuplicates(["id", "id2", "doc", "row", "line"]), ["id", "id2", "doc", "row", "line"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each run of equal keys; the input is sorted by its first ``keys`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _join_groups(rows: DataFrame, num: int, den: int, earlier: bool) -> DataFrame:
    """Trie join of each (cluster, part, part2); ``rows``: these, then doc, row, line, id, id2, wanted, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, c = [], [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c)], names=["x", "y", "z"])

        for _, group in _grouped(batches, 3):
            own: dict[tuple, tuple] = {}
            for doc, row, line, x, x2, wanted, tokens in group:
                old = own.get((x, x2))
                own[x, x2] = (doc, row, line, wanted or bool(old and old[3]), tokens)
            sets = [np.frombuffer(v[4], np.uint64) for v in own.values()]
            if earlier:
                hits = linked_to_earlier(sets, [v[:3] for v in own.values()], [v[3] for v in own.values()], num, den)
                for (x, x2), hit in zip(own, hits, strict=True):
                    if hit:
                        a.append(x)
                        b.append(x2)
                        c.append(0)
            else:
                ids = [x for x, _ in own]
                for i, root in enumerate(linked_components(sets, num, den)):
                    if root != i:
                        a.append(ids[i])
                        b.append(ids[root])
                        c.append(0)
            if len(a) > 50_000:
                yield out()
                a, b, c = [], [], []
        yield out()

    keys = ["cluster", "part", "part2"]
    dealt = rows.select(*keys, "doc", "row", "line", "id", "id2", "wanted", "tokens").repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(run), "x long, y long, z long").drop("z")


def link_clusters(sets: DataFrame, num: int, den: int, earlier: bool) -> DataFrame:
    """Links within clusters, enough for the question asked.

    ``sets``: id, id2, doc, row, line, cluster, size and weight (of the cluster), tokens.
    Returns, settled, (id, id2) of the sets that link with one of smaller (doc, row, line)
    if ``earlier``, else (a, b) edges over class ids that connect all linked classes.
    """
    chunk = F.pmod(F.xxhash64("id", "id2"), F.col("chunks")).cast("int")
    sets = sets.withColumn("chunks", F.greatest(F.ceil(F.col("size") / CLUSTER), F.ceil(F.col("weight") / CLUSTER_TOKENS)))
    small = sets.filter("chunks = 1").select("*", F.lit(0).alias("part"), F.lit(0).alias("part2"), F.lit(True).alias("wanted"))
    names = ["x", "y"]
    few = max(1, partitions(sets.sparkSession) // 4)  # for links, which are few beside sets
    first = settle(_join_groups(small, num, den, earlier))
    large = sets.filter("chunks > 1")
    if large.isEmpty():
        return first.toDF(*names)
    large = large.withColumn("part", chunk)
    lead = large.groupBy("cluster", F.pmod(F.xxhash64("id2"), F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct("doc", "row", "line", "id", "id2")).alias("p")).select(F.col("p.id").alias("id"), F.col("p.id2").alias("id2"))
    pivots = large.join(settle(lead), ["id", "id2"]).withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
    rows = large.unionByName(pivots).select("*", F.lit(0).alias("part2"), F.lit(True).alias("wanted"))
    second = settle(_join_groups(rows, num, den, earlier))
    # what is still open in large clusters meets every chunk of its cluster
    if earlier:
        rest = large.join(second.distinct().toDF("id", "id2"), ["id", "id2"], "left_anti")
        place = ["doc", "row", "line"]
        leaders = large.groupBy("cluster").agg(F.min(F.struct(*place)).alias("p")).select("cluster", "p.*")
        rest = rest.join(settle(leaders), ["cluster", *place], "left_anti")
    else:
        found = connected_components(second.toDF("a", "b"))
        tagged = settle(large.select("cluster", "id", "id2").join(found, F.col("id") == F.col("node"), "left").select("cluster", "id", "id2", F.coalesce("component", "id").alias("component")))
        counts = tagged.groupBy("cluster", "component").count()
        main = settle(counts.groupBy("cluster").agg(F.max(F.struct("count", "component")).alias("m")).select("cluster", F.col("m.component").alias("component")))
        rest = large.join(tagged.join(main, ["cluster", "component"], "left_anti").select("id", "id2"), ["id", "id2"])
    rest = settle(rest)
    counts = settle(rest.groupBy("cluster").agg(F.ceil(F.count("*") / CLUSTER).cast("int").alias("parts")))
    if counts.isEmpty():
        return settle(first.unionByName(second).coalesce(few).toDF(*names))
    asked = rest.join(counts, "cluster").withColumn("part2", F.pmod(F.xxhash64("id", "id2"), F.col("parts")).cast("int")).drop("part", "parts")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")))).withColumn("wanted", F.lit(True))
    against = large.join(counts, "cluster").withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").withColumn("wanted", F.lit(False))
    third = settle(_join_groups(asked.unionByName(against), num, den, earlier))
    return settle(first.unionByName(second).unionByName(third).coalesce(few).toDF(*names))


def clustered(cls: DataFrame, edges: DataFrame) -> DataFrame:
    """The classes that have a candidate, with their cluster, its size and its number of tokens (weight)."""
    found = connected_components(edges)
    members = settle(cls.select("id", "id2", "doc", "row", "line", "n").join(found.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id"))
    sizes = settle(members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).filter("size > 1"))
    return members.drop("n").join(sizes, "cluster")


def linked_classes(docs: DataFrame, doc: str, text: str, k: int, num: int, den: int, separators: np.ndarray = SPACE, by_row: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, classes), settled: (doc, row, n, id, id2) of every row, and (id, id2, least) of every class of sets.

    ``least`` is the first (doc, row) that links reach.  Texts of one doc id
    are connected, unless ``by_row``.
    """
    heavy = heavy_shingles(docs, text, k, separators)
    described = settle(describe(docs, doc, text, k, num, den, heavy, separators))
    cls = settle(classes(described))
    members = settle(clustered(cls, candidate_edges(cls, num, den)))
    sets = settle(with_sets(docs, doc, text, k, members, separators))
    edges = link_clusters(sets, num, den, earlier=False).toDF("a", "b")
    rows = described.select("doc", "row", "n", "id", "id2")
    if not by_row:
        several = settle(rows.filter("n > 0 and doc is not null").groupBy("doc").agg(F.min(F.struct("id", "id2")).alias("x"), F.max(F.struct("id", "id2")).alias("y")).filter("x <> y").select("doc", "x"))
        if not several.isEmpty():
            edges = edges.unionByName(rows.filter("n > 0").join(several, "doc").select(F.col("id").alias("a"), F.col("x.id").alias("b")))
    found = settle(connected_components(edges).withColumnRenamed("node", "id"))
    firsts = cls.select("id", "id2", F.struct("doc", "row").alias("first")).join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    firsts = settle(firsts)
    least = firsts.groupBy("component").agg(F.min("first").alias("least"))
    return rows, settle(firsts.join(least, "component").select("id", "id2", "least"))


def jaccard_components(docs: DataFrame, doc: str, text: str, k: int, num: int, den: int, separators: np.ndarray = SPACE) -> DataFrame:
    """(doc, n, component) of every row: its set's size and the least doc that its links reach.

    A null text counts as empty; an empty set links with nothing.  A null doc
    keeps a null component and links with nothing.  Repeated rows are equal
    sets and so linked; a doc id that comes with several texts is in one
    component by all of them (its rows without words keep their own id).
    """
    rows, cls = linked_classes(docs, doc, text, k, num, den, separators)
    known = rows.filter("n > 0 and doc is not null").join(cls, ["id", "id2"]).select("doc", "n", F.col("least.doc").alias("component"))
    rest = rows.filter("n = 0 or doc is null").select("doc", "n", F.col("doc").alias("component"))
    return known.unionByName(rest)

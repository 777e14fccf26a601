"""Importance resampling towards a target corpus.

Every document gets the floored mean of its features' gains, looked up in one
array by hashed bucket, plus a noise that its id alone decides (Gumbel top-k:
the highest scores are a draw without replacement, by weight).  The highest
scores are drawn by an external merge: tasks sort what can be drawn into runs,
the runs are dealt out by ranges of (score, id), and a tournament tree merges
the runs of a range and gives ranks until the exact count is drawn.

Words are runs of characters other than ASCII marks and white space, with A-Z
lower-cased; a feature is a run of 1 to ``longest`` words joined by one space.

Null texts have no words.  A row with a null id has weight but neither score
nor rank and isn't counted.  Rows that repeat an id all take part; of equal
scores and ids the lesser weight, then the fewer features, come first.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caravel.llm.shingles import buffers, chunks, word_spans
from caravel.llm.store import lean, partitions, settle, tidy
from caravel.llm.toxicity import PUNCTUATION

BUCKETS = 10_000
SEED = 2024
#: Most rows of a range, which one task merges, and of the runs that a task sorts at once.
RANGE_ROWS, RUN_ROWS = 200_000, 200_000
#: Most runs that one tree merges; more are merged in rounds.
FAN_IN = 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()
#: Longer spans go through zlib one by one; shorter ones a byte of all spans at a time.
_LONG = 48


def span_crcs(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of the bytes of each span."""
    size = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= _LONG]
    most = int(size[order[0]]) if len(order) else 0
    # how many spans are longer than k
    longer = np.searchsorted(-size[order], -np.arange(most), "left") if most else ()
    run, at = out[order], start[order]
    for k, m in enumerate(longer):
        run[:m] = _CRC[(run[:m] ^ text[at[:m] + k]) & 255] ^ (run[:m] >> 8)
    out[order] = run
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = zlib.crc32(text[start[i] : end[i]])
    return out


def feature_buckets(column: pa.Array, buckets: int, longest: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, one behind the last, words of each, features' rows, features' buckets), some rows at a time."""
    off, data = buffers(column)
    for i, j in chunks(off):
        own, text = off[i : j + 1] - off[i], _LOWER[data[off[i] : off[j]]]
        start, end = word_spans(text, own, PUNCTUATION)
        who = np.searchsorted(own, start, "right") - 1
        rows, found = [who], [span_crcs(text, start, end)]
        if longest > 1:
            # words one after another, a space behind each: runs of words are spans of it
            size = end - start + 1
            fresh_end = np.cumsum(size)
            fresh = fresh_end - size
            joined = np.full(int(size.sum()), 32, np.uint8)
            inner = np.arange(len(joined)) - np.repeat(fresh, size)
            inside = inner < np.repeat(size - 1, size)
            joined[inside] = text[(inner + np.repeat(start, size))[inside]]
            for n in range(2, longest + 1):
                at = np.flatnonzero(who[n - 1 :] == who[: len(who) - n + 1])
                rows.append(who[at])
                found.append(span_crcs(joined, fresh[at], fresh_end[at + n - 1] - 1))
        yield i, j, np.bincount(who, minlength=j - i), np.concatenate(rows), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str, buckets: int = BUCKETS, longest: int = 1) -> np.ndarray:
    """How many features of all texts fall into each bucket; tasks add up first, so ``buckets`` bounds what is collected."""
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in feature_buckets(batch.column(0), buckets, longest):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select(text).mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, target over source, floored."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((y + 1) * (s + k)) / float((x + 1) * (t + k)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc: int, seed: int) -> int:
    """Gumbel noise in thousandths, from sha256 of seed and id."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{doc}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def weigh(docs: DataFrame, doc: str, text: str, gain: np.ndarray, longest: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row; ``gain`` is one array, sized by the number of buckets."""
    shared = lean(docs.sparkSession).sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, n, total = (np.zeros(len(batch), np.int64) for _ in range(3))
            for i, j, count, rows, found in feature_buckets(batch.column(1), len(gain), longest):
                words[i:j] = count
                n[i:j] = np.bincount(rows, minlength=j - i)
                # whole numbers: sums of doubles are exact up to 2**53
                total[i:j] = np.bincount(rows, gain[found], minlength=j - i).astype(np.int64)
            weight = total // np.maximum(n, 1)
            ids = batch.column(0).to_pylist()
            score = [None if d is None else w + noise(d, seed) for d, w in zip(ids, weight.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(weight), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col(doc).cast("long").alias("doc_id"), text).mapInArrow(tidy(run), SCORED)


#: A row of a run: score with its sign turned, id, weight, features, how many rows are equal to it.
WIDTH = 5


def _ordered(rows: np.ndarray) -> np.ndarray:
    """Rows in order, equal ones joined to one with their number."""
    rows = rows[np.lexsort(rows.T[WIDTH - 2 :: -1])]
    fresh = np.append(True, (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1))
    at = np.flatnonzero(fresh)
    out = rows[at]
    out[:, -1] = np.add.reduceat(rows[:, -1], at)
    return out


def sorted_runs(able: DataFrame, splits: np.ndarray) -> DataFrame:
    """(range, rows, run): each task's rows in order, cut at ``splits``, which are rows (score turned, id)."""
    shared = lean(able.sparkSession).sparkContext.broadcast(splits)

    def runs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = _ordered(rows)
        edges = shared.value
        # a row's range is the number of splits that aren't behind it
        both = np.concatenate([edges, rows[:, :2]])
        order = np.lexsort((np.append(np.zeros(len(edges)), np.ones(len(rows))), both[:, 1], both[:, 0]))
        place = np.cumsum(order < len(edges))[order >= len(edges)]
        cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        parts = np.split(rows, cut[1:])
        yield pa.RecordBatch.from_arrays([pa.array(place[cut]), pa.array([int(p[:, -1].sum()) for p in parts], pa.int64()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], names=["range", "rows", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            doc, n, weight, score = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append(np.stack([-score, doc, weight, n, np.ones_like(doc)], axis=1))
            if sum(map(len, held)) >= RUN_ROWS:
                yield from runs(np.concatenate(held))
                held = []
        if sum(map(len, held)):
            yield from runs(np.concatenate(held))

    return able.select("doc_id", "n_features", "weight", "score").mapInArrow(tidy(run), "range long, rows long, run binary")


def tournament(runs: list[list]) -> Iterator[list]:
    """The rows of sorted runs in order, by a tree that keeps the loser of each match."""
    while len(runs) > FAN_IN:
        runs = [list(tournament(runs[i : i + FAN_IN])) for i in range(0, len(runs), FAN_IN)]
    if not runs:
        return
    end = [math.inf]
    size = 1 << (len(runs) - 1).bit_length()
    feeds = [iter(r) for r in runs] + [iter(())] * (size - len(runs))
    head = [next(f, end) for f in feeds]
    winner, loser = [0] * size + list(range(size)), [0] * size
    for node in range(size - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if head[a] <= head[b] else (b, a)
    best = winner[1]
    while head[best] is not end:
        yield head[best]
        head[best] = next(feeds[best], end)
        node = (best + size) >> 1
        while node:
            other = loser[node]
            if head[other] < head[best]:
                loser[node], best = best, other
            node >>= 1


def ranked(runs: DataFrame, before: dict[int, int], count: int, tasks: int) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): runs merged range by range; ranks go on from ``before`` and end with ``count``."""
    shared = runs.sparkSession.sparkContext.broadcast(before)

    def merge(place: int, packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        rank = shared.value[place]
        out = []
        for turned, doc, weight, n, times in tournament([np.frombuffer(p, "<i8").reshape(-1, WIDTH).tolist() for p in packed]):
            drawn = max(0, min(times, count - rank))
            if drawn:
                out.append((doc, n, weight, -turned, rank + 1, drawn))
            if drawn < times:  # the count is drawn
                out.append((doc, n, weight, -turned, None, times - drawn))
            rank += times
        names = ["doc_id", "n_features", "weight", "score", "first", "times"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for place, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and place != now:
                    yield from merge(now, held)
                    held = []
                now = place
                held.append(packed)
        if held:
            yield from merge(now, held)

    dealt = runs.select("range", "run").repartition(tasks, "range").sortWithinPartitions("range")
    rows = dealt.mapInArrow(tidy(run), "doc_id long, n_features long, weight long, score long, first long, times long")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return rows.select("doc_id", "n_features", "weight", "score", (F.col("first") + F.col("k")).alias("rank"))


def splits_of(able: DataFrame, scores: list[tuple[int, int]], size: int) -> np.ndarray:
    """Where ranges of about ``size`` rows begin, as (score turned, id); ``scores`` has the number of rows of each score, highest first.

    A score of more rows is cut by quantiles of its ids.
    """
    least = np.iinfo(np.int64).min
    out: list[tuple[int, int]] = []
    heavy: dict[int, int] = {}
    full = 0
    for score, n in scores:
        if full + n > size and full:
            out.append((-score, least))
            full = 0
        full += n
        if n > size:
            heavy[score] = -(-n // size)
    if heavy:
        cuts = [i / max(heavy.values()) for i in range(1, max(heavy.values()))]
        for score, ids in able.filter(F.col("score").isin(list(heavy))).groupBy("score").agg(F.percentile_approx("doc_id", cuts, 10_000)).collect():
            out += [(-score, x) for x in sorted(set(ids))]
    return np.array(sorted(out), np.int64).reshape(-1, 2)


def draw(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """``scored`` (settled) with ``rank``: the ``percent`` highest scores of the rows with ``min_words`` words, ties to the smaller id.

    Scores are thousandths of logarithms, so there are at most some 150,000
    different ones however many rows there are: their numbers of rows are
    collected and give the exact count, the score at which the draw ends, and
    ranges of rows.  Only rows from that score on are sorted and shuffled.
    """
    spark: SparkSession = scored.sparkSession
    able = scored.filter((F.col("n_words") >= min_words) & F.col("score").isNotNull())
    scores = sorted(((s, n) for s, n in able.groupBy("score").count().collect()), reverse=True)
    count = percent * sum(n for _, n in scores) // 100
    names = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not count:
        return scored.select(*names, none)
    upto = int(np.searchsorted(np.cumsum([n for _, n in scores]), count)) + 1
    last = scores[upto - 1][0]
    above = able.filter(F.col("score") >= last)
    size = min(RANGE_ROWS, -(-count // partitions(spark)))
    splits = splits_of(above, scores[:upto], size)
    runs = settle(sorted_runs(above, splits))
    before, total = {}, 0
    for place, n in sorted(runs.groupBy("range").agg(F.sum("rows")).collect()):
        before[place] = total
        total += n
    rest = scored.filter(~F.coalesce((F.col("n_words") >= min_words) & (F.col("score") >= last), F.lit(False)))
    return ranked(runs, before, count, len(before)).unionByName(rest.select(*names, none))


def resample(docs: DataFrame, doc: str, text: str, target: DataFrame, target_text: str, percent: int = 10, min_words: int = 20, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank is null where a row isn't drawn."""
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    return draw(settle(weigh(docs, doc, text, gain, longest, seed)), percent, min_words)

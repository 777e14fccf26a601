"""Exact top-k by inner product over an impact-ordered index.

Vectors are whole numbers.  Candidates lie in blocks; a block's index has, for
each dimension, a posting segment for each distance from the dimension's
median.  A query starts from its product with the medians and takes segments
by falling impact (weight times distance), a step at a time, adding them to
its candidates' scores.  What a candidate can still gain is bounded by the
dimensions it has not met yet: those that postings have reached count with the
largest impact left, the others with their own largest.  The k best so far are
scored exactly; a candidate is left out only on proof that it is below the
least of them.  Reading ends when scoring the members that remain costs less
than the next step, and these are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.llm.store import partitions, settle, tidy

#: Vectors of a block, on average.
CANDIDATES = 16384
#: A step takes this share of a block's postings, or what has the same impact as its last one.
STEP = 1 / 10
#: Components scored exactly in the time that one posting takes; measured.
POSTING = 2
EXACT, WHOLE = 2**53, 2**63


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a double; null if the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


class ImpactIndex:
    """Postings of one block: by dimension, candidates by falling distance from its median; segments are runs of one distance."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows, self.fine = ids, rows, rows.astype(float)
        n, dims = rows.shape
        self.center = np.partition(rows, n // 2, axis=0)[n // 2]
        apart = (rows - self.center).T
        far = np.abs(apart)
        order = np.argsort(-far, axis=1, kind="stable")
        self.postings = np.ascontiguousarray(order)
        self.apart = np.take_along_axis(apart, order, axis=1)
        self.wide = self.apart.astype(float)
        far = np.take_along_axis(far, order, axis=1)
        cut = np.append(np.ones((dims, 1), bool), far[:, 1:] != far[:, :-1], axis=1)
        start = np.flatnonzero(cut.ravel())
        self.far, self.dim = far.ravel()[start], start // n
        self.size = np.diff(np.append(start, n * dims))
        self.peak = far[:, 0]
        self.most = np.abs(rows).max(axis=0).astype(float)
        # a power of two above the number of dimensions: a sum of gains and their number in one addition
        self.spread = 1 << dims.bit_length()

    def _met(self, query: np.ndarray, before: np.ndarray, after: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gains and their numbers by candidate, exact, of each dimension's postings from ``before`` to ``after``."""
        n = len(self.ids)
        total = int((after - before).sum())
        who = np.empty(total, np.int64)
        gain = np.empty(total, float if narrow else np.int64)
        source, scale = (self.wide, query * float(self.spread)) if narrow else (self.apart, query)
        at = 0
        for d in np.flatnonzero(after > before).tolist():
            i, j = before[d], after[d]
            upto = at + int(j - i)
            who[at:upto] = self.postings[d, i:j]
            np.multiply(source[d, i:j], scale[d], out=gain[at:upto])
            at = upto
        if narrow:
            gain += 1.0
            both = np.bincount(who, gain, minlength=n).astype(np.int64)
            return both // self.spread, both % self.spread
        sums = np.zeros(n, np.int64)
        np.add.at(sums, who, gain)
        return sums, np.bincount(who, minlength=n)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores) of the best k candidates but ``own``, ties to the smaller id; and how many were scored exactly at the end."""
        n, dims = self.rows.shape
        weight = np.abs(query)
        reach = float(weight.astype(float) @ self.most)
        if 4 * reach >= WHOLE:
            raise ValueError("components are too large: a product passes 63 bits")
        fine = query.astype(float)
        product = (lambda at: (self.fine[at] @ fine).astype(np.int64)) if reach < EXACT else (lambda at: self.rows[at] @ query)
        members = np.flatnonzero(self.ids != own)
        if len(members) > k:
            peak = weight * self.peak
            impact = weight[self.dim] * self.far
            narrow = 4 * reach * self.spread < EXACT
            order = np.argsort(-impact)
            falling = impact[order]
            read = np.cumsum(self.size[order])
            score = np.full(n, int(query @ self.center))
            seen = np.zeros(n, np.int64)
            taken = np.zeros(dims, np.int64)
            at = 0
            step = max(1, int(STEP * n * dims))
            while at < len(order) and falling[at] > 0:
                done = int(read[at - 1]) if at else 0
                if len(members) * dims <= POSTING * min(step, int(read[-1]) - done):
                    break
                level = max(1, int(falling[min(int(np.searchsorted(read, done + step)), len(order) - 1)]))
                at = int(np.searchsorted(-falling, -level, "right"))
                whole = impact >= level
                upto = np.bincount(self.dim[whole], self.size[whole], minlength=dims).astype(np.int64)
                add, met = self._met(query, taken, upto, narrow)
                taken = upto
                score += add
                seen += met
                rest = int(falling[at]) if at < len(order) else 0
                best = score[members]
                lead = members[np.argpartition(best, len(best) - k)[len(best) - k :]]
                reached = upto > 0
                most = best + (int(reached.sum()) - seen[members]) * rest + int(peak[~reached].sum())
                members = members[most >= product(lead).min()]
        exact = product(members)
        scored = len(members)
        if len(members) > k:
            keep = exact >= np.partition(exact, len(exact) - k)[len(exact) - k]
            members, exact = members[keep], exact[keep]
        order = np.lexsort((self.ids[members], -exact))[:k]
        return self.ids[members][order], exact[order], scored


def top_k(vectors: DataFrame, vec: str, vector: str, every: int, k: int, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries: rows whose id ``every`` divides.

    Candidates are all rows but those of the query's id, with as many
    components.  Rows that are not ``quantised`` or have a null id take no
    part; repeated rows count once.  Products that pass 63 bits raise.  Each
    vector goes to one block, once; queries go to every block of their number
    of components.  The partial lists, k for each query and block, are ranked
    in two steps.
    """
    own = vectors.filter(F.col(vec).isNotNull()).select(F.col(vec).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v")).filter("v is not null").distinct()
    own = settle(own.withColumn("dims", F.size("v")))
    blocks = max(1, -(-own.count() // CANDIDATES))
    stored = own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(False))
    asked = own.filter(F.col("id") % every == 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
    keys = ["dims", "block"]
    rows = stored.unionByName(asked).select(*keys, "asks", "id", "v").repartition(max(partitions(vectors.sparkSession), blocks), *keys).sortWithinPartitions(*keys, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, index, ids, held = None, None, [], []
        for batch in batches:
            places = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (0, 1)], axis=1)
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            cut = np.append(np.flatnonzero(np.append(True, (places[1:] != places[:-1]).any(axis=1) | (asks[1:] != asks[:-1]))), len(asks))
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if (now := tuple(places[i].tolist())) != key:
                    key, index, ids, held = now, None, [], []
                dims = now[0]
                number = batch.column(3).slice(i, j - i).to_numpy()
                own_rows = batch.column(4).slice(i, j - i).flatten().to_numpy().reshape(j - i, dims)
                if not asks[i]:
                    ids.append(number)
                    held.append(own_rows)
                    continue
                if not ids:
                    continue
                if index is None:
                    index = ImpactIndex(np.concatenate(ids), np.concatenate(held)) if dims else np.concatenate(ids)
                out: list[list[np.ndarray]] = [[], [], []]
                for asking, query in zip(number.tolist(), own_rows, strict=True):
                    if dims:
                        found, scores, _ = index.top(query, asking, k)
                    else:
                        found = np.sort(index[index != asking])[:k]
                        scores = np.zeros(len(found), np.int64)
                    for column, x in zip(out, (np.full(len(found), asking), found, scores), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    found = rows.mapInArrow(tidy(run), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

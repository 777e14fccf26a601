"""An inverted-file index for vectors: learnt centroids, lists of rows by nearest centroid, searched a few lists at a time.

Centroids are fitted on a bounded sample; every row is assigned to the list of
its nearest centroid and written as Parquet, partitioned by list.  Beside them
each list's centroid, radius and number of rows are kept.  A search multiplies
queries with the rows of the nearest lists.  It can be made exact: by the
triangle inequality a list holds nothing nearer than the distance to its
centroid less its radius, so a second pass over the lists that this doesn't
rule out gives what a scan of all rows gives.  How many lists a search takes is
measured when the index is built: so many that the neighbours of some rows,
found exactly, lie in them at the wanted rate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caravel.operators.vectors import SCORES, block_products, top_k_cosine
from caravel.session import settled

#: Most rows that centroids are fitted on (those of least hash), most lists, and rows of a list that are multiplied at once.
SAMPLE, LISTS, PART_ROWS = 20_000, 4_096, 8_192
#: Most bytes of vectors that centroids are fitted on, whatever their size.
SAMPLE_BYTES = 64 << 20
#: Rows whose neighbours are found exactly, and how many of each, to learn how many lists a search needs.
TRIALS, NEIGHBOURS = 200, 10


def unit_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, grp, v): vectors of length 1; null, zero and not finite ones take no part."""
    own = df.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    own = own.filter(fine & (F.size("v") > 0)).withColumn("n", length).filter("n > 0")
    return own.select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def fit(rows: np.ndarray, lists: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Centroids of unit rows: first ones far from each other, then rounds of nearest centroids and their means; empty ones take the farthest rows."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(rows)))]
    far = 2 - 2 * rows @ rows[chosen[0]]
    while len(chosen) < min(lists, len(rows)):
        chance = np.maximum(far, 0)
        total = chance.sum()
        if total <= 1e-12:
            break
        chosen.append(int(rng.choice(len(rows), p=chance / total)))
        far = np.minimum(far, 2 - 2 * rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(rounds):
        score = rows @ centroids.T
        own = score.argmax(axis=1)
        means = np.zeros_like(centroids)
        np.add.at(means, own, rows)
        size = np.bincount(own, minlength=len(centroids))
        empty = np.flatnonzero(size == 0)
        if len(empty):
            means[empty] = rows[np.argsort(score.max(axis=1), kind="stable")[: len(empty)]]
        length = np.linalg.norm(means, axis=1, keepdims=True)
        centroids = np.where(length > 1e-12, means / np.maximum(length, 1e-12), centroids)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batch: pa.RecordBatch, each: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces whose rows, at ``each`` numbers a row, come to ``SCORES`` numbers at most."""
    step = max(1, SCORES // max(1, each))
    for i in range(0, len(batch), step):
        yield batch.slice(i, step)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * a @ b.T))


def needed_lists(rows: DataFrame, made: DataFrame, centroids: np.ndarray, wanted: float) -> int:
    """The fewest nearest lists in which the share ``wanted`` of the neighbours of ``TRIALS`` rows lies."""
    trials = settled(rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIALS))
    near = top_k_cosine(trials, rows, "id", "v", NEIGHBOURS)
    where = near.join(made.select("id", "list"), "id").groupBy("query_id").agg(F.collect_list("list").alias("lists"))
    places = []
    for vector, lists in trials.join(where, F.col("id") == F.col("query_id")).select("v", "lists").collect():
        rank = np.empty(len(centroids), np.int64)
        rank[np.argsort(_distance(np.array([vector]), centroids)[0], kind="stable")] = np.arange(len(centroids))
        places += rank[lists].tolist()
    return int(np.sort(places)[min(len(places) - 1, int(np.ceil(wanted * len(places))))]) + 1 if places else 1


def build(df: DataFrame, key: str, vector: str, path: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 42, wanted: float = 0.95) -> None:
    """Write an index of ``df`` to a folder of the shared storage.

    Vectors of the most frequent size are indexed.  Without ``lists`` there are
    about the root of the number of rows, at most ``LISTS``.  ``wanted`` is the
    share of neighbours that a search should find.
    """
    spark = df.sparkSession
    rows = settled(unit_rows(df, key, vector))
    sizes = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        raise ValueError("no vector can be indexed")
    rows = rows.filter(F.size("v") == sizes["dims"])
    some = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(sample, SAMPLE_BYTES // (8 * sizes["dims"])))).select("v").toArrow()
    fitted = fit(_matrix(some["v"].combine_chunks()), lists or max(1, min(LISTS, round(sizes["count"] ** 0.5))), seed=seed)
    shared = spark.sparkContext.broadcast(fitted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for batch in _slices(batch, len(shared.value)):
                far = _distance(_matrix(batch.column(1)), shared.value)
                own = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far[np.arange(len(own)), own])], names=["id", "v", "list", "far"])

    made = settled(rows.mapInArrow(assign, "id long, v array<double>, list int, far double"))
    held = {r["list"]: (r["rows"], r["radius"]) for r in made.groupBy("list").agg(F.count("*").alias("rows"), F.max("far").alias("radius")).collect()}
    probe = needed_lists(rows, made, fitted, wanted)
    about = [(i, fitted[i].tolist(), n, radius, -(-n // PART_ROWS), probe) for i, (n, radius) in sorted(held.items())]
    meta = spark.createDataFrame(about, "list int, centroid array<double>, rows long, radius double, parts int, probe int")
    # a list of very many rows is dealt to several parts, so that no task holds it whole
    placed = made.join(F.broadcast(meta.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed.select("list", "part", "id", "v").repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")


def search(spark: SparkSession, path: str, queries: DataFrame, key: str, vector: str, k: int, probe: int | None = None, exact: bool = False, decimals: int = 6) -> DataFrame:
    """(query_id, rank, id, similarity): the ``k`` most similar rows in the ``probe`` nearest lists (as many as were found to be needed), or with ``exact`` in all.

    A row with the query's own id is left out; equal similarities (to
    ``decimals``) go to the smaller id.  An exact search bounds each query by
    the k-th best of its nearest lists.
    """
    about = spark.read.parquet(f"{path}/lists").orderBy("list").collect()
    asked = unit_rows(queries, key, vector)
    shared = spark.sparkContext.broadcast((np.array([r["list"] for r in about], np.int32), np.array([r["centroid"] for r in about]), np.array([r["radius"] for r in about]), np.array([r["parts"] for r in about])))
    dims, probe = len(about[0]["centroid"]), probe or about[0]["probe"]
    asked = settled(asked.filter(F.size("v") == dims))
    # a query that asks every list comes to so many numbers
    spread = dims * int(sum(r["parts"] for r in about))
    shape = "list int, part int, id long, v array<double>"

    def chosen(batch: pa.RecordBatch, pick) -> pa.RecordBatch:
        names, centroids, radius, parts = shared.value
        far = _distance(_matrix(batch.column(1)), centroids)
        which, at = np.nonzero(pick(far, radius))
        times = parts[at]
        which, at = np.repeat(which, times), np.repeat(at, times)
        part = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, np.int64)
        take = pa.array(which)
        return pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(part.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], names=["list", "part", "id", "v"])

    def nearest(far: np.ndarray) -> np.ndarray:
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, np.argsort(far, axis=1, kind="stable")[:, :probe], True, axis=1)
        return out

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, spread):
                yield chosen(some, lambda far, radius: nearest(far))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, spread):
                worst = some.column(2).to_numpy(zero_copy_only=False)
                # similarities are rounded: what is equal once rounded may be a little farther
                reach = np.sqrt(np.maximum(0.0, 2 - 2 * (worst - 2 * 10.0**-decimals)))
                yield chosen(some, lambda far, radius, reach=reach: (far - radius <= reach[:, None] + 1e-9) & ~nearest(far))

    def found(pairs: DataFrame) -> DataFrame:
        pairs = settled(pairs)
        lists = [r["list"] for r in pairs.select("list").distinct().collect()]
        stored = spark.read.parquet(f"{path}/rows").filter(F.col("list").isin(lists))  # other partitions aren't read
        block = (F.col("list").cast("long") * (1 << 20) + F.col("part")).alias("block")
        none = F.lit(None).cast("string").alias("grp")
        return block_products(stored.select(block, "id", none, "v"), pairs.select(block, "id", none, "v"), k, decimals)

    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    best = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
    top = best(found(asked.select("id", "v").mapInArrow(first, shape)))
    if not exact:
        return top
    top = settled(top)
    worst = top.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("worst"))
    bound = asked.join(worst, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("worst", F.lit(-1.0)).alias("worst"))
    more = found(bound.mapInArrow(rest, shape))
    return best(top.drop("rank").unionByName(more.select("query_id", "id", "similarity")))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of the true (query_id, id) pairs that were found."""
    both = truth.select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"]).count()
    return both / max(1, truth.count())

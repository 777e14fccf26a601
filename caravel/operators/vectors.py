"""Vector tables: validity, means, exact top-k similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def issues(v: Column, dims: int, tolerance: float = 1e-3) -> Column:
    """What is wrong with a vector, as a list: missing, dimension, not_finite, not_unit."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.array_compact(
        F.array(
            F.when(v.isNull(), "missing"),
            F.when(v.isNotNull() & (F.size(v) != dims), "dimension"),
            F.when(v.isNotNull() & ~finite, "not_finite"),
            F.when(v.isNotNull() & finite & (F.abs(norm(v) - 1) > tolerance), "not_unit"),
        )
    )


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, position, value): means of each component, pre-aggregated where the rows lie."""
    return df.select(group, F.posexplode(vector).alias("position", "x")).groupBy(group, "position").agg(F.avg(F.col("x").cast("double")).alias("value"))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is 1, component by component; null if none is."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: F.transform(x["t"], lambda y: y.cast("double")))
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.get(kept, F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


def with_documents(found: DataFrame, index: DataFrame, key: str, *columns: str) -> DataFrame:
    """Hits (query_id, rank, id, similarity) with columns of the indexed rows; similarity is kept within -1 and 1."""
    rows = index.select(F.col(key).alias("id"), *columns)
    return found.withColumn("similarity", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("similarity")))).join(rows, "id")


def short_queries(found: DataFrame, k: int, able: int) -> DataFrame:
    """(query_id, n): queries with other than the smaller of ``k`` and ``able`` hits."""
    return found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") != min(k, able))


#: Vectors of a candidate block, on average; scores that a task holds at once.
BLOCK, SCORES = 8192, 1 << 20


def top_k_cosine(queries: DataFrame, index: DataFrame, key: str, vector: str, k: int, group: str | None = None, decimals: int = 6) -> DataFrame:
    """(query_id, rank, id, similarity) by products of blocks.

    A candidate with the query's own key, or its ``group``, is left out; zero,
    null and odd-sized vectors take no part.  Equal similarities (to
    ``decimals``) go to the smaller id.  Each vector goes to one block; queries
    go to every block, are multiplied in batches, and bring ``k`` rows from each.
    """
    parts = max(1, -(-index.count() // BLOCK))
    own = lambda df: df.select(F.col(key).cast("long").alias("id"), (F.col(group) if group else F.lit(None)).cast("string").alias("grp"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    stored = own(index).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)))
    asked = own(queries).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = block_products(stored, asked, k, decimals)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def block_products(stored: DataFrame, asked: DataFrame, k: int, decimals: int = 6) -> DataFrame:
    """(query_id, id, similarity): the ``k`` best rows of each block for each query that asks it.

    Both sides have block, id, grp and v (doubles).  A task holds one block at
    a time and multiplies it with as many of its queries as make ``SCORES``
    scores; blocks of other sizes of vectors are kept apart.
    """
    spark = stored.sparkSession
    fields = ["block", "id", "grp", "v"]
    rows = stored.select(*fields).withColumn("asks", F.lit(False)).unionByName(asked.select(*fields).withColumn("asks", F.lit(True)))
    rows = rows.withColumn("block", F.col("block").cast("long")).filter(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))).withColumn("dims", F.size("v"))
    keys = ["dims", "block"]
    dealt = rows.filter("dims > 0").select(*keys, "asks", "id", "grp", "v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            places = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2)], axis=1)
            cut = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist(), len(places)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                dims, number, asks = places[i].tolist()
                if (dims, number) != at:
                    at, held, block = (dims, number), [], None
                ids = batch.column(3).slice(i, j - i).to_numpy()
                groups = np.array(batch.column(4).slice(i, j - i).to_pylist(), object)
                v = batch.column(5).slice(i, j - i).flatten().to_numpy().reshape(j - i, dims)
                length = np.linalg.norm(v, axis=1)
                some = length > 0
                part = ids[some], groups[some], v[some] / length[some, None]
                if not asks:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    block, held = tuple(np.concatenate(x) for x in zip(*held, strict=True)), [None]
                step = max(1, SCORES // max(1, len(block[0])))
                for at_ in range(0, len(part[0]), step):
                    yield best(*(x[at_ : at_ + step] for x in part), *block)

    def best(ids: np.ndarray, groups: np.ndarray, vectors: np.ndarray, names: np.ndarray, kinds: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        score = vectors @ block.T
        np.round(score, decimals, out=score)
        out: list[list[np.ndarray]] = [[], [], []]
        for q, g, own in zip(ids.tolist(), groups, score, strict=True):
            able = np.flatnonzero((names != q) & ((kinds != g) if g is not None else True))
            if len(able) > k:
                able = able[own[able] >= np.partition(own[able], len(able) - k)[len(able) - k]]
            first = able[np.lexsort((names[able], -own[able]))[:k]]
            for column, x in zip(out, (np.full(len(first), q), names[first], own[first]), strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "id", "similarity"])

    return dealt.mapInArrow(run, "query_id long, id long, similarity double")


def best_key_form(keys: DataFrame, key: str, forms: dict[str, Column], index: DataFrame, index_key: str) -> DataFrame:
    """(form, hits, asked): how many keys each way of writing them finds in the index, best first."""
    rows = keys.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("form"), c.cast("string").alias("k")) for i, (n, c) in enumerate(forms.items())])).alias("x")).select("x.*")
    known = index.select(F.col(index_key).cast("string").alias("k")).distinct().withColumn("hit", F.lit(1))
    return rows.join(known, "k", "left").groupBy("ord", "form").agg(F.count("hit").alias("hits"), F.count("*").alias("asked")).orderBy(F.desc("hits"), "ord").drop("ord")


def reconciled(keys: DataFrame, key: str, forms: dict[str, Column], index: DataFrame, index_key: str, probe: int = 200, seed: int = 42) -> tuple[str, DataFrame]:
    """(form, keys with ``stored``): all keys in the form that most of ``probe`` seeded keys have in the index; of equal forms the one tried first.

    No hit at all raises.
    """
    some = keys.select(key).distinct().orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key)), 256)).limit(probe)
    best = best_key_form(some, key, forms, index, index_key).first()
    if best is None or not best["hits"]:
        raise ValueError("no form of the ids is in the index; tried " + ", ".join(forms))
    return best["form"], keys.withColumn("stored", forms[best["form"]])

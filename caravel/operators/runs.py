"""Evaluation runs: pairing, caches, review, shared retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.operators.ordering import running, same

#: Labels that one chunk of equal runs holds; a pair of chunks makes at most the square of it.
CHUNK = 1024


def _chunks(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, chunk, labels, rows): the labels of equal rows in chunks of ``CHUNK`` at most, and how many equal rows there are in all."""
    placed = running(rows.select(*keys, F.col(label).alias("_label")), keys, ["_label"], into="_at")
    made = placed.groupBy(*keys, F.floor(F.col("_at") / CHUNK).alias("chunk")).agg(F.collect_list(F.struct("_label")).alias("labels"))
    total = made.groupBy(*keys).agg(F.sum(F.size("labels")).alias("rows"))
    other = total.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], "rows")
    return made.join(other, same([F.col(k) for k in keys], [F.col(f"_t{i}") for i in range(len(keys))]))


def compatible_pairs(runs: DataFrame, label: str, fine: Column, fields: list[str], identity: str | None = None, retrieves: str | None = None, index_fields: list[str] | None = None) -> DataFrame:
    """(fine, base): each run that ``fine`` marks with each other run equal, nulls included, in all ``fields``.

    Where ``retrieves`` holds for the marked run, ``index_fields`` must be equal
    too.  A marked run whose ``identity`` is null or empty, and which several
    others fit, is paired with none of them.

    There are as many pairs as equal runs multiplied, so runs meet as chunks of
    equal ones, and pairs of chunks are dealt out before they are spelt out: a
    group of any size is shared by all tasks.
    """
    spark = runs.sparkSession
    named = F.coalesce(F.col(identity).cast("string"), F.lit("")) != "" if identity else F.lit(True)
    strict = F.coalesce(F.col(retrieves), F.lit(False)) if retrieves else F.lit(False)
    marked = runs.withColumns({"_fine": fine, "_named": named, "_strict": strict})

    def pairs(of: DataFrame, equal: list[str]) -> DataFrame:
        names = [f"_f{i}" for i in range(len(equal))]
        keyed = lambda df, *more: df.select(*[F.col(f).alias(n) for f, n in zip(equal, names, strict=True)], *more, F.col(label).alias("_own"))
        a = _chunks(keyed(of, "_named"), [*names, "_named"], "_own").select(*names, "_named", F.col("chunk").alias("_a"), F.col("labels").alias("_fines"))
        b = _chunks(keyed(marked.filter(~F.col("_fine"))), names, "_own").select(*[F.col(n).alias(f"_b{n}") for n in names], F.col("chunk").alias("_b"), F.col("labels").alias("_bases"), "rows")
        met = a.join(b, same([F.col(n) for n in names], [F.col(f"_b{n}") for n in names])).filter("_named or rows = 1")
        dealt = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *names, "_named", "_a", "_b")
        each = dealt.select(F.explode("_fines").alias("_x"), "_bases").select(F.col("_x._label").alias("fine"), F.explode("_bases").alias("_y"))
        return each.select("fine", F.col("_y._label").alias("base"))

    every = marked.filter("_fine")
    if not retrieves:
        return pairs(every, fields)
    return pairs(every.filter("not _strict"), fields).unionByName(pairs(every.filter("_strict"), [*fields, *(index_fields or [])]))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def cache_misses(rows: DataFrame, cache: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows that the cache has not under the same fingerprint."""
    return rows.join(cache.select(key, fingerprint), [key, fingerprint], "left_anti")


#: What must be equal between a cached record and its sample, and between evidence and what is known.
CACHED = ("question", "reference", "images")


def cache_defects(cache: DataFrame, samples: DataFrame, knowledge: DataFrame, key: str, fingerprint: str, k: int, fields: tuple[str, ...] = CACHED) -> DataFrame:
    """The rows of ``cache`` with ``defects``, the sorted names of what speaks against each.

    ``cache`` has the key, its place (file, line), fingerprint, ``fields``,
    prediction and evidence, an array of structs of the key, ``fields`` and
    similarity.  A record must be of a sample, under this fingerprint, with the
    sample's content and a prediction; its evidence must be as many items as
    ``k`` and the knowledge allow, each of another known id with that id's
    content and a finite similarity, and none of a sample that is tested.
    All evidence is checked by one join.
    """
    pool = min(k, knowledge.count()) if k else 0
    content = lambda of: F.struct(*[of(f).alias(f) for f in fields])
    own = samples.select(F.col(key).alias("_id"), content(F.col).alias("_content"))
    told = cache.withColumn("_r", F.struct("file", "line")).join(own, F.col(key) == F.col("_id"), "left")
    known = knowledge.select(F.col(key).alias("_k"), content(F.col).alias("_known")).join(samples.select(F.col(key).alias("_k"), F.lit(True).alias("_tested")), "_k", "full_outer")
    each = cache.select(F.struct("file", "line").alias("_r"), F.explode("evidence").alias("e")).join(known, F.col(f"e.{key}") == F.col("_k"), "left")
    finite = F.coalesce(~F.isnan("e.similarity") & (F.abs("e.similarity") < float("inf")), F.lit(False))
    wrong = each.groupBy("_r").agg(
        F.max(F.col("_known").isNull() & F.col("_tested").isNull()).alias("unknown"),
        F.max(F.coalesce("_tested", F.lit(False))).alias("tested"),
        (F.count_distinct(f"e.{key}") < F.count(f"e.{key}")).alias("repeated"),
        F.max(F.col("_known").isNotNull() & ~F.col("_known").eqNullSafe(content(lambda f: F.col(f"e.{f}")))).alias("changed"),
        F.max(~finite).alias("similarity"),
    )
    joined = told.join(wrong.withColumnRenamed("_r", "_w"), F.col("_r") == F.col("_w"), "left")
    checks = {
        "no_sample": F.col("_id").isNull(),
        "fingerprint": ~F.col("fingerprint").eqNullSafe(F.lit(fingerprint)),
        "content": F.col("_id").isNotNull() & ~F.col("_content").eqNullSafe(content(F.col)),
        "prediction": F.col("prediction").isNull(),
        "evidence_count": F.coalesce(F.size("evidence"), F.lit(-1)) != pool,
        **{f"evidence_{n}": F.coalesce(F.col(n), F.lit(False)) for n in ("unknown", "tested", "repeated", "changed", "similarity")},
    }
    return joined.select(*cache.columns, F.array_sort(F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))).alias("defects"))


def valid_cache(cache: DataFrame, samples: DataFrame, knowledge: DataFrame, key: str, fingerprint: str, k: int, fields: tuple[str, ...] = CACHED) -> DataFrame:
    """One row for each sample that the cache can answer: of records without defects the one of the last file and line."""
    good = cache_defects(cache, samples, knowledge, key, fingerprint, k, fields).filter("size(defects) = 0").drop("defects")
    return good.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*cache.columns), F.struct("file", "line")).alias("_x")).select("_x.*")


def backfilled(rows: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with fields that are null filled from the source."""
    other = source.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(other, F.col(key) == F.col("_key"), "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(f, f"_{f}"))
    return joined.drop("_key", *[f"_{f}" for f in fields])


def review_reasons(reasons: dict[str, Column], separator: str = "；") -> Column:
    """The names of the reasons that hold, joined; empty if none does."""
    return F.concat_ws(separator, *[F.when(c, F.lit(n)) for n, c in reasons.items()])


def largest_difference(a: DataFrame, b: DataFrame, key: str, value: str, count: int) -> DataFrame:
    """(key, difference): the ``count`` largest absolute differences, ties by key."""
    joined = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return joined.select(key, F.abs(F.col("_a") - F.col("_b")).alias("difference")).filter("difference is not null").orderBy(F.desc("difference"), key).limit(count)


def shared_retrieval(requests: DataFrame, run: str, query: str, k: str, ranked: DataFrame) -> DataFrame:
    """Each request's first k of one shared ranked list (query, rank, ...): retrieved once with the largest k."""
    most = requests.groupBy(query).agg(F.max(k).alias("_most"))
    once = ranked.join(most, query).filter(F.col("rank") <= F.col("_most")).drop("_most")
    return requests.join(once, query).filter(F.col("rank") <= F.col(k))


def choice_scores(chosen: Column, right: Column) -> tuple[Column, Column]:
    """Accuracy (same set) and F1 of two arrays of labels; null if there is no right label, 0 if none is chosen."""
    both = F.size(F.array_intersect(chosen, right))
    able = F.size(right) > 0
    n = F.coalesce(F.size(F.array_distinct(chosen)), F.lit(0))
    m = F.size(F.array_distinct(right))
    f1 = F.when(n > 0, 2.0 * both / (n + m)).otherwise(F.lit(0.0))
    return F.when(able, ((both == m) & (n == m)).cast("double")), F.when(able, f1)

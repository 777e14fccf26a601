"""Resumable ingest: every key once, however often a run starts again."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from caravel.operators.plugins import signature


#: Buckets that keys are dealt to; a batch reads the stored keys of its own buckets only.
BUCKETS = 256


def ingest(stream: DataFrame, key: str, target: str, checkpoint: str, order: str, transform: Callable[[DataFrame], DataFrame] | None = None, config: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Append each key's first row (by ``order``) that ``target`` (Parquet) has not; runs until the input is used up.

    A batch takes one row for each key (a null is a key too), leaves out keys
    that are stored, does the costly ``transform`` for the rest only, and
    appends.  The target is partitioned by ``_bucket``, a hash of the key: a
    batch looks for its keys in the buckets that these fall into and reads
    their key column, nothing else of what is stored.  The checkpoint moves on
    after the append, so a replay finds its rows stored.  ``config`` and the
    number of buckets are written beside the first rows; a later run under
    others is refused, and so is a target with fewer rows than were stored.
    """
    spark = stream.sparkSession
    config = config or {}
    opened(spark, target, config, buckets)
    bucket = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\x00"))), F.lit(buckets)).cast("int")

    def store(batch: DataFrame, _: int) -> None:
        # the least of a key's rows is found where they lie before any is shuffled
        least = F.min_by(F.struct(*batch.columns), F.struct(F.col(order), F.xxhash64(*batch.columns)))
        fresh = batch.groupBy(F.col(key).alias("_k")).agg(least.alias("_x")).select("_x.*").withColumn("_bucket", bucket)
        fresh = fresh.persist()
        try:
            stored = stored_keys(spark, target, key, [r["_bucket"] for r in fresh.select("_bucket").distinct().collect()])
            if stored is not None:
                fresh_ = fresh.join(stored, fresh[key].eqNullSafe(stored["_stored"]) & (fresh["_bucket"] == stored["_in"]), "left_anti")
            else:
                fresh_ = fresh
            made = fresh_.drop("_bucket")
            made = (transform(made) if transform else made).withColumn("_bucket", bucket)
            made.repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(target)
        finally:
            fresh.unpersist()
        rows = spark.read.parquet(target).select(F.count("*").alias("rows"), F.lit(signature(**config)).alias("signature"), F.lit(json.dumps(config, sort_keys=True)).alias("config"), F.lit(buckets).alias("buckets"))
        rows.coalesce(1).write.mode("append").parquet(f"{target}-runs")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_keys(spark: SparkSession, target: str, key: str, buckets: list[int]) -> DataFrame | None:
    """(_stored, _in): the keys of some buckets of a target, read from their partitions alone; None without a target."""
    stored = _stored(spark, target)
    return None if stored is None else stored.filter(F.col("_bucket").isin(buckets)).select(F.col(key).alias("_stored"), F.col("_bucket").alias("_in"))


def opened(spark: SparkSession, target: str, config: dict, buckets: int | None = None) -> DataFrame | None:
    """The stored rows, or None; raises where they were stored under another configuration or some are gone."""
    runs = _stored(spark, f"{target}-runs")
    if runs is None:
        return None
    own = signature(**config)
    last = runs.agg(F.max("rows").alias("rows"), F.max(F.when(F.col("signature") != own, F.struct("signature", "config"))).alias("other"), F.max("buckets").alias("buckets")).first()
    if last["other"]:
        raise ValueError(f"{target} was made under another configuration: {', '.join(differing(json.loads(last['other']['config']), config))}")
    if buckets is not None and last["buckets"] != buckets:
        raise ValueError(f"{target} was made under another configuration: {last['buckets']} buckets")
    stored = _stored(spark, target)
    if (0 if stored is None else stored.count()) < (last["rows"] or 0):
        raise ValueError(f"{target} has fewer rows than were stored")
    return stored


def differing(recorded: dict, expected: dict) -> list[str]:
    """The names, also of nested settings, whose values are not the same on both sides."""
    out = []
    for name in sorted(set(recorded) | set(expected)):
        a, b = recorded.get(name), expected.get(name)
        if isinstance(a, dict) and isinstance(b, dict):
            out += [f"{name}.{x}" for x in differing(a, b)]
        elif a != b:
            out.append(name)
    return out


def open_index(spark: SparkSession, target: str, config: dict, dimension: int, vector: str, space: str = "cosine") -> DataFrame:
    """The rows of an index made by ``ingest`` under ``config``, whose vectors all have ``dimension`` components.

    ``config`` says how vectors are made (model and sizes of its weights,
    instruction, pooling, version) and which ``space`` they are for; every
    setting that differs from what was recorded is named.  No index raises.
    """
    if config.get("space", space) != space:
        raise ValueError(f"{target} is for another space than {space}")
    rows = opened(spark, target, config)
    if rows is None:
        raise ValueError(f"{target}: there is no index")
    if not (wrong := rows.filter(F.coalesce(F.size(vector), F.lit(-1)) != dimension).limit(1)).isEmpty():
        raise ValueError(f"{target}: a vector of {wrong.select(F.size(vector)).first()[0]} components instead of {dimension}")
    return rows


def _stored(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.parquet(target)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def hourly_counts(stream: DataFrame, time: str, kind: str, late: str = "1 hour") -> DataFrame:
    """An extension: counts by hour and kind with a watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), kind, "n")

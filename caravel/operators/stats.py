"""Summaries of metrics: coverage, Wilson and bootstrap intervals, paired differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.operators.ordering import running
from caravel.session import settled

#: Quantile of the normal distribution for 95 % intervals. Fixed value.
Z = 1.959963984540054


def wilson(p: Column, n: Column) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of a share; null where n is 0."""
    z2 = Z * Z
    center = (p + z2 / (2 * n)) / (1 + z2 / n)
    radius = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), center - radius)), F.when(some, F.least(F.lit(1.0), center + radius))


def summary_columns(value: Column, applies: Column | None = None) -> list[Column]:
    """n, total, coverage, mean and std (of the population): nulls count in total, not in n."""
    applies = F.lit(True) if applies is None else applies
    own = F.when(applies, value)
    n, total = F.count(own), F.count_if(applies)
    return [n.alias("n"), total.alias("total"), F.when(total > 0, n / total).otherwise(F.lit(0.0)).alias("coverage"), F.avg(own).alias("mean"), F.stddev_pop(own).alias("std")]


def long_metrics(df: DataFrame, keys: list[str], metrics: dict[str, Column]) -> DataFrame:
    """One row for each metric of each row: keys, metric, value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])
    return df.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric", "m.value")


def metric_summary(df: DataFrame, group: str, metrics: dict[str, Column]) -> DataFrame:
    """Summaries of each metric overall (group is ``*``) and by group."""
    rows = long_metrics(df, [group], metrics)
    summed = rows.groupingSets([["metric"], ["metric", group]], "metric", group).agg(*summary_columns(F.col("value")), F.grouping(group).alias("_all"))
    return summed.withColumn(group, F.when(F.col("_all") == 1, "*").otherwise(F.col(group))).drop("_all")


#: A prime below 2**31, and what is added in the rounds of mixing.
PRIME, ROUNDS = 2**31 - 1, (1013904223, 715225741)
#: Rows of a block at least, and most blocks of a group.
BLOCK, BLOCKS = 256, 4096


def drawn(level: int, a, b, c, seed: int, n) -> np.ndarray:
    """Whole numbers below ``n`` from a hash of three numbers: sums modulo a prime, whose fifth powers mix them twice.

    The fifth power is a permutation modulo ``PRIME``; two such numbers side by
    side leave no visible bias for ``n`` up to 2**50.
    """

    def mixed(salt: int) -> np.ndarray:
        x = (np.asarray(a, np.int64) * 48271 + np.asarray(b, np.int64) * 69621 + np.asarray(c, np.int64) * 16807 + level * 1299709 + salt) % PRIME
        for k in ROUNDS:
            y = x * x % PRIME
            x = (y * y % PRIME * x + k) % PRIME
        return x

    return (mixed(seed) * 2**31 + mixed(seed + 77_777)) % n


def bootstrap(df: DataFrame, group: str, value: str, order: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """(group, n, mean, ci_low, ci_high): 2.5 and 97.5 percentiles of the means of resamples of n rows out of n.

    Rows have places in their group by ``order`` and lie in blocks of places.
    A first round deals the n draws of each resample to blocks, a second draws
    that many rows inside each block: every resample has exactly n draws, no
    group is in one task, and only sums are shuffled.  Draws come from hashes,
    so they are the same everywhere.  Null values take no part; a group of one
    row has no interval.
    """
    kind = df.schema[group].dataType.simpleString()
    rows = running(df.filter(F.col(value).isNotNull()).select(F.col(group).alias("key"), F.col(value).cast("double").alias("value"), F.col(order).alias("_order")), ["key"], ["_order"], into="place")
    about = settled(rows.groupBy("key").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).withColumn("size", F.greatest(F.lit(BLOCK), F.floor(F.col("n") / BLOCKS))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, size, sample) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                count = np.zeros(-(-n // size), np.int64)
                for at in range(0, n, 1 << 20):
                    count += np.bincount(drawn(1, np.arange(at, min(n, at + (1 << 20))), sample, 0, seed, n) // size, minlength=len(count))
                block = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(block), i))), pa.array(block), pa.array(np.full(len(block), sample)), pa.array(count[block])], names=["key", "block", "sample", "draws"])

    asked = about.select("key", "n", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))).alias("sample"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.repartition(tasks, "key", "sample").mapInArrow(deal, f"key {kind}, block long, sample long, draws long")
    dealt = dealt.groupBy("key", "block").agg(F.collect_list(F.struct("sample", "draws")).alias("asked"))
    placed = rows.join(about.select(F.col("key").alias("_key"), "size"), F.col("key").eqNullSafe(F.col("_key"))).withColumn("block", F.floor(F.col("place") / F.col("size")))
    held = placed.groupBy(F.col("key").alias("_key"), F.col("block").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("x")).select("_key", "_block", F.transform("x", lambda x: x["value"]).alias("values"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                block, values = batch.column(1)[i].as_py(), batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                sample, draws = (np.array(x, np.int64) for x in zip(*((a["sample"], a["draws"]) for a in batch.column(2)[i].as_py()), strict=True))
                total = np.array([sum(float(values[drawn(2, np.arange(at, min(m, at + (1 << 20))), b, block, seed, len(values))].sum()) for at in range(0, m, 1 << 20)) for b, m in zip(sample.tolist(), draws.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(sample), i))), pa.array(sample), pa.array(total), pa.array(draws)], names=["key", "sample", "total", "draws"])

    met = dealt.join(held, F.col("key").eqNullSafe(F.col("_key")) & (F.col("block") == F.col("_block"))).select("key", "block", "asked", "values")
    sums = met.mapInArrow(draw, f"key {kind}, sample long, total double, draws long").groupBy("key", "sample").agg((F.sum("total") / F.sum("draws")).alias("m"))
    ends = sums.groupBy(F.col("key").alias("_key")).agg(F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"))
    out = about.join(ends, F.col("key").eqNullSafe(F.col("_key")))
    return out.select(F.col("key").alias(group), "n", "mean", F.when(F.col("n") > 1, F.col("ci_low")).alias("ci_low"), F.when(F.col("n") > 1, F.col("ci_high")).alias("ci_high"))


def paired(after: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """(key, delta) of rows on both sides; null where either value is."""
    a, b = after.select(key, F.col(value).alias("_a")), before.select(key, F.col(value).alias("_b"))
    return a.join(b, key).select(key, (F.col("_a") - F.col("_b")).alias("delta"))


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right, both): how two sets of keys differ."""
    left, right = a.select(F.col(key).alias("_l")).distinct(), b.select(F.col(key).alias("_r")).distinct()
    both = left.join(right, F.col("_l") == F.col("_r"), "full_outer")
    return both.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"))

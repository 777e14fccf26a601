"""Places and running sums within groups of any size, and digests of ordered rows.

A window over a group puts the group into one task.  Here rows are dealt out by
ranges of (group, order), each range sums up what it has of each group, and
only these sums are put in order: no task holds more than a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.session import settled


def same(a: list[Column], b: list[Column]) -> Column:
    """Whether keys are equal, nulls included."""
    return reduce(lambda x, y: x & y, [p.eqNullSafe(q) for p, q in zip(a, b, strict=True)])


def running(df: DataFrame, group: list[str], order: list[str], weight: Column | None = None, into: str = "before", tasks: int | None = None) -> DataFrame:
    """``df`` with ``into``: the sum of ``weight`` (1, if none is given: the place from 0) over the rows before each in its group.

    Rows equal in group and order are in one task; their order is open.
    """
    own = df.select(F.struct(*[c for c in df.columns if c != into]).alias("row"), (F.lit(1) if weight is None else weight).cast("long").alias("w"))
    keys = [F.col(f"row.{c}") for c in group]
    by = [*keys, *[F.col(f"row.{c}") for c in order]]
    n = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settled(own.repartitionByRange(n, *by).sortWithinPartitions(*by).select("row", "w", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")))
    names = [f"g{i}" for i in range(len(group))]
    sums = rows.groupBy(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.col("p").alias("q")).agg(F.sum("w").alias("s"))
    ahead = F.coalesce(F.sum("s").over(Window.partitionBy(*names).orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*names, "q", ahead.alias("ahead"))
    inner = F.coalesce(F.sum("w").over(Window.partitionBy(*keys, "p").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inner", inner).join(sums, same([*keys, F.col("p")], [F.col(n) for n in [*names, "q"]]))
    return placed.select("row.*", (F.col("ahead") + F.col("inner")).alias(into))


#: Digests that one node of a tree joins, and the rounds of joining: room for 10**12 rows.
FAN, LEVELS = 1024, 4


def ordered_digest(df: DataFrame, group: str, order: str, digest: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(group, digest): one digest of each group's digests in the order of ``order``.

    Leaves are joined ``fan`` by ``fan`` in their order, their joined text is
    hashed, and so on for ``levels`` rounds, which leave one node: a node never
    holds more than ``fan`` digests.
    """
    nodes = running(df.select(group, order, digest), [group], [order], into="_at").select(group, "_at", F.col(digest).alias("_d"))
    for _ in range(levels):
        nodes = nodes.groupBy(group, F.floor(F.col("_at") / fan).alias("_up")).agg(F.array_sort(F.collect_list(F.struct("_at", "_d"))).alias("_x"))
        nodes = nodes.select(group, F.col("_up").alias("_at"), F.sha2(F.array_join(F.transform("_x", lambda x: x["_d"]), ""), 256).alias("_d"))
    return nodes.select(group, F.col("_d").alias("digest"))


def table_digest(df: DataFrame, key: str, *columns: str) -> str:
    """The digest of a table's rows in the order of their keys; nested columns count as JSON, a null differs from an empty text."""
    nested = {n for n, k in df.dtypes if k.startswith(("struct", "array", "map"))}
    text = lambda c: F.coalesce(F.to_json(c) if c in nested else F.col(c).cast("string"), F.lit("\x00"))
    rows = df.select(F.lit(0).alias("_g"), key, F.sha2(F.concat_ws("\x1f", *[text(c) for c in (key, *columns)]), 256).alias("_h"))
    found = ordered_digest(rows, "_g", key, "_h").first()
    return found["digest"] if found else ""

"""Reproducible samples: quotas, tiers, disjoint splits, apportionment.

Random order is the order of sha256(seed|salt|id), so a sample depends on ids
and seed alone, not on partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.operators.ordering import running

#: Question types in the order that breaks ties. Fixed values.
TYPES = ("open_ended", "closed_ended", "single_choice", "multiple_choice")


def lot(seed: int, salt: str, key: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key.cast("string")), 256)


def allocate(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Whole quotas that sum to ``total``: floors, then one more for the largest fractions, ties in the order given."""
    if not ratios or any(isinstance(v, bool) or not math.isfinite(v) or v < 0 for v in ratios.values()) or sum(ratios.values()) <= 0:
        raise ValueError("ratios must be finite, not negative, and positive in sum")
    whole = sum(ratios.values())
    exact = {k: total * v / whole for k, v in ratios.items()}
    out = {k: int(v) for k, v in exact.items()}
    order = sorted(ratios, key=lambda k: -(exact[k] - out[k]))
    for k in order[: total - sum(out.values())]:
        out[k] += 1
    return out


def type_counts(counts: dict[str, int]) -> dict[str, int]:
    """Counts in the order of ``TYPES``; each type and no other must be given, with whole numbers that aren't negative and are positive in sum."""
    if set(counts) != set(TYPES) or any(type(v) is not int or v < 0 for v in counts.values()) or not sum(counts.values()):
        raise ValueError("counts need the keys " + ", ".join(TYPES) + " and whole numbers, none negative, not all 0")
    return {t: counts[t] for t in TYPES}


def type_ratios(ratios: dict[str, float]) -> dict[str, float]:
    """Shares of 1 in the order of ``TYPES``; each type and no other must be given, with finite numbers that aren't negative and are positive in sum."""
    if set(ratios) != set(TYPES) or any(type(v) not in (int, float) or not math.isfinite(v) or v < 0 for v in ratios.values()) or not sum(ratios.values()):
        raise ValueError("ratios need the keys " + ", ".join(TYPES) + " and finite numbers, none negative, not all 0")
    whole = sum(ratios.values())
    return {t: ratios[t] / whole for t in TYPES}


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, quota) over a table of weights, a row for each key; ties by key."""
    everything = weights.agg(F.sum(weight).alias("_sum"))
    exact = weights.crossJoin(F.broadcast(everything)).withColumn("_exact", F.lit(total) * F.col(weight) / F.col("_sum"))
    exact = exact.withColumn("_floor", F.floor("_exact"))
    order = Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), key)
    left = Window.partitionBy()
    return exact.withColumn("_rank", F.row_number().over(order)).withColumn("_left", F.lit(total) - F.sum("_floor").over(left)).select(key, (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("int")).cast("long").alias("quota"))


def priority_sample(df: DataFrame, key: str, tier: Column, count: int, seed: int, salt: str) -> DataFrame:
    """``count`` rows, lower tiers first, at random within a tier; a top-k, so no full sort meets in one task."""
    return df.withColumn("_tier", tier).withColumn("_lot", lot(seed, salt, F.col(key))).orderBy("_tier", "_lot", key).limit(count).withColumnRenamed("_tier", "tier").drop("_lot")


def quota_sample(df: DataFrame, key: str, group: str, tier: Column, quotas: dict[str, int], seed: int, salt: str) -> DataFrame:
    """For each group its quota of rows, lower tiers first, at random within a tier; groups never borrow.

    The rank filter is kept per partition before the shuffle (window group limit).
    """
    most = max(quotas.values(), default=0)
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(group)] if quotas else F.lit(0)
    order = Window.partitionBy(group).orderBy("tier", "_lot", key)
    ranked = df.withColumn("tier", tier).withColumn("_lot", lot(seed, salt, F.col(key))).withColumn("_rank", F.row_number().over(order))
    return ranked.filter((F.col("_rank") <= most) & (F.col("_rank") <= F.coalesce(quota, F.lit(0)))).drop("_lot", "_rank")


def without_shared(pool: DataFrame, key: str, shared: str, chosen: DataFrame) -> DataFrame:
    """``pool`` without the chosen keys and without keys that share any value of ``shared`` with a chosen one.

    Both tables have a row for each (key, shared) pair.
    """
    values = chosen.select(shared).distinct()
    touched = pool.join(values, shared, "left_semi").select(key).distinct()
    return pool.join(touched, key, "left_anti").join(chosen.select(key).distinct(), key, "left_anti")


def limit_each(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rank") <= limit).drop("_rank")


def require_unique(ids: DataFrame, key: str) -> DataFrame:
    """``ids``, unless there is none or one is null, blank or repeated: then ValueError."""
    if ids.isEmpty():
        raise ValueError(f"no {key}")
    wrong = ids.groupBy(F.trim(F.col(key).cast("string")).alias("k")).count().filter("count > 1 or coalesce(k, \'\') = \'\'").limit(5).collect()
    if wrong:
        raise ValueError(f"{key} repeated or empty: " + ", ".join(sorted(str(r["k"]) for r in wrong)))
    return ids


def tagged(samples: DataFrame, key: str, indexed: DataFrame, index_key: str, matches: Column) -> DataFrame:
    """Samples with embedded, keyword and tier: 0 for both, 1 for embedded, 2 for keyword, 3 for neither."""
    known = indexed.select(F.col(index_key).alias("_k")).distinct().withColumn("_in", F.lit(True))
    out = samples.join(known, samples[key] == F.col("_k"), "left").withColumn("embedded", F.col("_in").isNotNull()).drop("_k", "_in")
    out = out.withColumn("keyword", F.coalesce(matches, F.lit(False)))
    return out.withColumn("tier", F.when(F.col("embedded") & F.col("keyword"), 0).when(F.col("embedded"), 1).when(F.col("keyword"), 2).otherwise(3))


def tag_counts(tagged_samples: DataFrame, group: str, category: str, kinds: tuple[str, ...] = TYPES) -> DataFrame:
    """(group, total, embedded, missing, keyword, both, one column for each category): the audit of a population, or of chosen roles."""
    n = lambda c: F.count_if(c)
    e, k = F.col("embedded"), F.col("keyword")
    return tagged_samples.groupBy(group).agg(F.count("*").alias("total"), n(e).alias("embedded"), n(~e).alias("missing"), n(k).alias("keyword"), n(e & k).alias("both"), *[n(F.col(category) == x).alias(x) for x in kinds])


def sample_roles(samples: DataFrame, key: str, category: str, test: dict[str, int], train: dict[str, int], seed: int, shared: str | None = None) -> DataFrame:
    """(key, category, tier, embedded, keyword, role): a test sample, then a train sample of what shares nothing with it.

    ``samples`` is ``tagged``; quotas are by category.  ``shared`` names an
    array (such as image keys): rows that share an element with a test row are
    in no train sample.  Too few rows of any category raise, and name it.
    """
    have = {r[category]: r["count"] for r in samples.groupBy(category).count().collect()}
    short = [f"{c}: {test.get(c, 0)} + {train.get(c, 0)} asked, {have.get(c, 0)} there" for c in {**test, **train} if have.get(c, 0) < test.get(c, 0) + train.get(c, 0)]
    if short:
        raise ValueError("too few samples: " + "; ".join(short))
    tests = quota_sample(samples, key, category, F.col("tier"), test, seed, "test")
    rest = samples.join(tests.select(key), key, "left_anti")
    if shared:
        values = tests.select(F.explode(shared).alias("_v")).distinct()
        hit = rest.select(key, F.explode(shared).alias("_v")).join(values, "_v", "left_semi").select(key).distinct()
        rest = rest.join(hit, key, "left_anti")
    trains = quota_sample(rest, key, category, F.col("tier"), train, seed, "train")
    left = {r[category]: r["count"] for r in trains.groupBy(category).count().collect()}
    short = [f"{c}: {n} asked, {left.get(c, 0)} left" for c, n in train.items() if left.get(c, 0) < n]
    if short:
        raise ValueError("too few samples outside the test: " + "; ".join(short))
    fields = [key, category, "tier", "embedded", "keyword"]
    return tests.select(*fields, F.lit("test").alias("role")).unionByName(trains.select(*fields, F.lit("train").alias("role")))


def evaluation_split(samples: DataFrame, key: str, reserved: DataFrame, count: int | None = None, knowledge: int | None = None, seed: int = 42, shared: str | None = None, kinds: list[str] | None = None, category: str = "category") -> tuple[DataFrame, DataFrame]:
    """(test, knowledge) for an evaluation.

    ``reserved``: (ord, key) of the fixed test set; every id must be there
    once.  The test has those of ``kinds``, then the first ``count``; the
    knowledge leaves out all reserved ids however few are tested, and rows that
    share an element of ``shared`` with a tested one, and is a seeded sample of
    ``knowledge`` rows.
    """
    require_unique(reserved, key)
    lost = reserved.join(samples.select(key), key, "left_anti").limit(5).collect()
    if lost:
        raise ValueError("not in the data: " + ", ".join(sorted(str(r[key]) for r in lost)))
    test = samples.join(reserved.select(key, "ord"), key)
    if kinds:
        test = test.filter(F.col(category).isin(*kinds))
    test = test.orderBy("ord", key).limit(count) if count else test
    rest = samples.join(reserved.select(key), key, "left_anti")
    if shared:
        values = test.select(F.explode(shared).alias("_v")).distinct()
        hit = rest.select(key, F.explode(shared).alias("_v")).join(values, "_v", "left_semi").select(key).distinct()
        rest = rest.join(hit, key, "left_anti")
    if knowledge:
        rest = rest.orderBy(lot(seed, "knowledge", F.col(key)), key).limit(knowledge)
    return test, rest


def shuffled_split(df: DataFrame, key: str, test: int, train: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) of seeded rows, which have nothing in common.

    Without ``train`` the first ``test`` rows in the order of their lots are
    the test and all others train; there must be others.  With it the first
    ``train`` rows train and the next ``test`` are the test; if there are too
    few, the test gets what is left.
    """
    if test < 1 or (train is not None and train < 1):
        raise ValueError("sizes must be at least 1")
    order = [lot(seed, "split", F.col(key)), F.col(key)]
    if train is None:
        if (n := df.count()) <= test:
            raise ValueError(f"more than {test} rows are needed, there are {n}")
        first = df.orderBy(*order).limit(test)
        return df.join(first.select(key), key, "left_anti"), first
    first = df.orderBy(*order).limit(train)
    return first, df.join(first.select(key), key, "left_anti").orderBy(*order).limit(test)


def seeded_rows(df: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """``count`` distinct rows by the order of their lots, in the order of keys: a sample for a look at the data."""
    return df.orderBy(lot(seed, "look", F.col(key)), key).limit(count).orderBy(key)


def one_example(df: DataFrame, key: str, text: str, most: int, seed: int | None = None, index: int | None = None) -> DataFrame:
    """One row: the given place in the order of keys, else the first (or with ``seed`` a random one) of those whose text is short enough, or of all if none is."""
    if index is not None:
        return df.orderBy(key).offset(index).limit(1)
    short = F.char_length(text) <= most
    return df.orderBy(F.when(short, 0).otherwise(1), *([] if seed is None else [lot(seed, "one", F.col(key))]), key).limit(1)


def accepted_counts(df: DataFrame, group: str, index: Column, accepted: Column, limit: int) -> DataFrame:
    """(group, seen, accepted, skipped) when each group is read in the order of ``index`` until ``limit`` rows are accepted; a group may hold any share of the rows."""
    own = df.select(group, index.alias("_i"), F.coalesce(accepted, F.lit(False)).cast("int").alias("_ok"))
    own = running(own, [group], ["_i"], F.col("_ok"), "_n")
    return own.filter(F.col("_n") < limit).groupBy(group).agg(F.count("*").alias("seen"), F.sum("_ok").alias("accepted"), F.count_if(F.col("_ok") == 0).alias("skipped"))

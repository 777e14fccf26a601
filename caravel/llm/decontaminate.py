"""Benchmark decontamination: prefix-filtered join of item windows with documents.

DataFrame functions only.  A window is ``size`` consecutive words of a
benchmark item (a shorter item is one window).  Words are ordered by how often
they occur in the documents; a document can hold a window only where it has
the window's rarest word at the window's place, so only these places are
joined, bounded by the document's length, and then compared word by word.
While the windows take few enough bytes to be broadcast, all of this happens in
the scan, and only places that are hit leave it: no text is shuffled to find
them.  Windows go by a number of their own; the items that share one, however
many, are looked up once a document's windows are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.llm.store import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: every ASCII character that is neither a letter nor a digit.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a settled table up to which it is broadcast; beyond it Spark shuffles both sides.
BROADCAST_BYTES = 64 << 20
#: What a row takes besides its texts and lists.
ROW_BYTES = 64


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; none for a null."""
    found = F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def few(df: DataFrame, *texts: Column) -> bool:
    """Whether a settled table, of which ``texts`` are the columns that vary in size, takes at most ``BROADCAST_BYTES``."""
    weight = F.lit(ROW_BYTES)
    for t in texts:
        weight = weight + F.octet_length(t)
    return (df.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_BYTES


def bounded(df: DataFrame, *texts: Column) -> DataFrame:
    """``df`` marked for broadcast if it is small enough; else as it is."""
    return F.broadcast(df) if few(df, *texts) else df


def item_windows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """(window, window_words, items): the distinct windows with the sorted ids, as strings, that have them.

    Items with a null id or without words have none; repeated rows count once.
    """
    own = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    rows = own.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), size).alias("window_words"))
    return rows.groupBy("window_words").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.array_join("window_words", " ").alias("window"), "window_words", "items")


def decontaminate(docs: DataFrame, doc: str, text: str, benchmark: DataFrame, item: str, item_text: str, size: int = 10) -> DataFrame:
    """The rows of ``docs`` with n_words, n_hit, items and contaminated.

    A word is hit if it lies in any occurrence of any window; ``items`` are
    the sorted ids (strings) with a window in the text.  Null and empty texts
    have no words.  Each row is judged by its own text, also where ids repeat
    or are null.  Columns of ``docs`` with these names are replaced.
    """
    # numbers of settled rows stay the same
    windows = settle(item_windows(benchmark, item, item_text, size))
    windows = settle(windows.withColumn("wid", F.monotonically_increasing_id()))
    vocabulary = settle(windows.select(F.explode("window_words").alias("w")).distinct())
    counts = docs.select(F.explode(words(F.col(text))).alias("w")).join(bounded(vocabulary, F.col("w")), "w").groupBy("w").count()
    ranked = windows.select("wid", "window", F.size("window_words").alias("len"), F.posexplode("window_words").alias("off", "w"))
    ranked = ranked.join(settle(counts), "w", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = F.min(F.struct("count", "w", "off")).alias("r")
    prefix = settle(ranked.groupBy("wid", "window", "len").agg(rarest).select("wid", "window", "len", F.col("r.w").alias("w"), F.col("r.off").alias("off")))
    hits = hit_places(docs, doc, text, prefix).groupBy("_doc", "_row").agg(F.array_sort(F.collect_set(F.struct("at", "len"))).alias("c"), F.collect_set("wid").alias("wids"))
    end = lambda x: x["at"] + x["len"]
    # places come in order: each adds what lies behind the end reached so far
    total = F.aggregate(
        "c",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], end(x)).alias("end"), (s["n"] + F.greatest(F.lit(0), end(x) - F.greatest(s["end"], x["at"]))).alias("n")),
        lambda s: s["n"],
    )
    hits = settle(hits.select("_doc", "_row", total.alias("n"), "wids"))
    shared = windows.select("wid", "items")
    each = hits.select("_doc", "_row", F.explode("wids").alias("wid")).join(bounded(shared, F.array_join("items", "")), "wid")
    # windows of a document share most of their items: the lists are joined without repeats
    named = each.select("_doc", "_row", F.explode("items").alias("item")).distinct().groupBy("_doc", "_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hits = hits.select(F.col("_doc").alias("_d0"), F.col("_row").alias("_r0"), "n").join(named, F.col("_d0").eqNullSafe(F.col("_doc")) & (F.col("_r0") == F.col("_row"))).select("_doc", "_row", "n", "items")
    hits = settle(hits)
    hits = bounded(hits, F.array_join("items", "")).select(F.struct("*").alias("_h"))
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "contaminated")]
    fresh = docs.select(F.struct(*names).alias("_d"))
    text_ = F.col(f"_d.{text}")
    joined = fresh.join(hits, F.col(f"_d.{doc}").eqNullSafe(F.col("_h._doc")) & (row_of(F.col(f"_d.{doc}"), text_) == F.col("_h._row")), "left")
    n = F.coalesce(F.col("_h.n"), F.lit(0)).cast("long")
    return joined.select(
        *[F.col(f"_d.{c}").alias(c) for c in names],
        F.size(words(text_)).cast("long").alias("n_words"),
        n.alias("n_hit"),
        F.coalesce(F.col("_h.items"), F.array().cast("array<string>")).alias("items"),
        (n > 0).alias("contaminated"),
    )


def row_of(doc: Column, text: Column) -> Column:
    """A hash that tells rows of one doc id with different texts apart."""
    return F.xxhash64(doc, text)


def hit_places(docs: DataFrame, doc: str, text: str, prefix: DataFrame) -> DataFrame:
    """(_doc, _row, at, len, wid): where a document has a whole window; ``prefix`` is settled.

    With a broadcast ``prefix`` the words stay at hand where places are found
    (one generated loop over a text's words, nothing is copied), so each place
    is compared there.  Otherwise the places found are shuffled to their texts.
    """
    own = docs.select(F.col(doc).alias("_doc"), row_of(F.col(doc), F.col(text)).alias("_row"), words(F.col(text)).alias("_w"))
    start = (F.col("at") - F.col("off")).alias("at")
    fits = (F.col("at") >= F.col("off")) & (F.col("at") - F.col("off") + F.col("len") <= F.col("_n"))
    same = lambda at: F.array_join(F.slice("_w", at + 1, F.col("len")), " ") == F.col("window")
    if few(prefix, F.col("window"), F.col("w")):
        places = own.select("_doc", "_row", "_w", F.size("_w").alias("_n"), F.posexplode("_w").alias("at", "w"))
        found = places.join(F.broadcast(prefix), "w").filter(fits).filter(same(F.col("at") - F.col("off")))
        return found.select("_doc", "_row", start, "len", "wid")
    places = own.select("_doc", "_row", F.size("_w").alias("_n"), F.posexplode("_w").alias("at", "w"))
    found = places.join(prefix, "w").filter(fits).select("_row", start, "len", "wid", "window").distinct()
    return found.join(own, "_row").filter(same(F.col("at"))).select("_doc", "_row", "at", "len", "wid")

"""Question-answer corpora: classes of pairs, keywords, chats, fact overlap."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.functions.text import role_name, url_only

CLASSES = ("missing_question", "missing_answer", "url_only", "usable")


def pair_class(question: Column, answer: Column, keep_urls: bool = False) -> Column:
    """The one class of a pair, tested in the order of ``CLASSES``."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(empty(question), "missing_question").when(empty(answer), "missing_answer").when(url_only(F.trim(answer)) & F.lit(not keep_urls), "url_only").otherwise("usable")


def class_counts(df: DataFrame, group: str, kind: Column, kinds: tuple[str, ...] = CLASSES) -> DataFrame:
    """Counts of each class by group and in total (group ``TOTAL``)."""
    rows = df.select(group, kind.alias("_kind")).rollup(group).agg(F.count("*").alias("total"), *[F.count_if(F.col("_kind") == k).alias(k) for k in kinds], F.grouping(group).alias("_all"))
    return rows.withColumn(group, F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(group))).drop("_all")


def keyword_pattern(keywords: list[str]) -> str:
    """A pattern (Java) of whole phrases in any case; ``Term (ABBR)`` stands for both, inner white space is free."""
    phrases: list[str] = []
    for line in keywords:
        flat = " ".join(line.split())
        if not flat or flat.startswith("#"):
            continue
        both = re.fullmatch(r"(.+\S) \(([^()]+)\)", flat)
        phrases += [both[1], both[2]] if both else [flat]
    if not phrases:
        raise ValueError("no keywords")
    found = dict.fromkeys(r"\s+".join(re.escape(w) for w in p.split()) for p in phrases)
    return r"(?iuU)(?<!\w)(?:" + "|".join(found) + r")(?!\w)"


def mentions(values: Column, keywords: list[str]) -> Column:
    """Whether any of an array of texts holds a keyword; a phrase doesn't span two texts."""
    pattern = keyword_pattern(keywords)
    return F.coalesce(F.exists(values, lambda v: v.rlike(pattern)), F.lit(False))


MESSAGES = "array<struct<role:string,content:string>>"


def normalized_chat(messages: Column, system: str) -> Column:
    """Canonical messages, or null if fewer than three are left.

    Roles are named, blank or unknown messages dropped, a system message put
    first where none is, and what follows the last assistant cut.
    """
    named = F.transform(messages, lambda m: F.struct(role_name(m["role"]).alias("role"), F.trim(m["content"]).alias("content")))
    clean = F.filter(named, lambda m: m["role"].isin("user", "assistant", "system") & (F.coalesce(m["content"], F.lit("")) != ""))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    whole = F.when(F.exists(clean, lambda m: m["role"] == "system"), clean).otherwise(F.concat(first, clean))
    back = F.array_position(F.reverse(F.transform(whole, lambda m: m["role"])), "assistant")
    kept = F.when(back > 0, F.slice(whole, 1, (F.size(whole) - back + 1).cast("int")))
    return F.when(F.size(kept) >= 3, kept)


def first_user(messages: Column) -> Column:
    return F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]


def last_answer(messages: Column) -> Column:
    return F.element_at(messages, -1)["content"]


def supervised_prefix(text: Column, answer: Column) -> Column:
    """The text before the last place of the answer; null if it isn't in it."""
    back = F.instr(F.reverse(text), F.reverse(answer))
    return F.when(back > 0, F.substr(text, F.lit(1), F.char_length(text) - (back - 1) - F.char_length(answer)))


def collected_turns(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, messages) in the order of turns."""
    rows = df.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(turn, F.col(role).alias("role"), F.col(text).alias("content")))).alias("m"))
    return rows.select(conversation, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def claims(text: Column) -> Column:
    """Distinct sentences in order."""
    parts = F.filter(F.transform(F.split(text, r"[。！？!?；;\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.array_distinct(parts)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^a-z0-9]+"), ""))


def overlap_score(claim: Column, source: Column) -> Column:
    """1, 0.5 or 0: how much of the claim's words the source has (0.8, 0.4)."""
    share = F.when(F.size(claim) > 0, F.size(F.array_intersect(claim, source)) / F.size(claim)).otherwise(F.lit(0.0))
    return F.when(share >= 0.8, 1.0).when(share >= 0.4, 0.5).otherwise(0.0)

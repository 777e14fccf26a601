"""Very many keywords over nested texts, in one pass.

Keywords go into one automaton with failure links, so a text is read once
however many there are.  A phrase counts where it isn't part of a longer word,
in any case and with any white space between its words; ``Term (ABBR)`` stands
for both of its names.  A phrase never reaches from one text into another.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases that one automaton takes; more keywords are dealt out to several passes.
PHRASE_BYTES = 32 << 20


def phrases(keyword: str) -> list[str]:
    """The texts that a keyword stands for, as they are looked for; none for a blank line or a comment."""
    flat = " ".join(keyword.split())
    if not flat or flat.startswith("#"):
        return []
    both = re.fullmatch(r"(.+\S) \(([A-Za-z][A-Za-z0-9]*)\)", flat)
    return [x.casefold() for x in (both.groups() if both else (flat,))]


@functools.lru_cache(maxsize=2)
def automaton(entries: tuple[tuple[str, str], ...]):
    """An automaton over (phrase, keyword) pairs; a phrase of several keywords gives all of them."""
    import ahocorasick

    found: dict[str, list[str]] = {}
    for phrase, keyword in entries:
        found.setdefault(phrase, []).append(keyword)
    out = ahocorasick.Automaton()
    for phrase, names in found.items():
        out.add_word(phrase, (len(phrase), tuple(dict.fromkeys(names))))
    out.make_automaton()
    return out


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def hits(text: str, machine) -> list[str]:
    """The distinct keywords in a text, in the order in which they end."""
    flat = " ".join(text.split()).casefold()
    out: dict[str, None] = {}
    for end, (size, names) in machine.iter(flat):
        begin = end - size + 1
        # what has a word character at its edge must not go on beyond it
        if (begin == 0 or not _word(flat[begin - 1])) and (end + 1 == len(flat) or not _word(flat[end + 1])):
            out.update(dict.fromkeys(names))
    return list(out)


def keyword_hits(df: DataFrame, key: str, leaves: str, keywords: list[str]) -> DataFrame:
    """(key, leaf, keyword): every keyword that a text of the array ``leaves`` holds, with the text's place from 0, once each.

    Null texts hold none; no keyword at all raises.
    """
    entries = sorted({(p, " ".join(k.split())) for k in keywords for p in phrases(k)})
    if not entries:
        raise ValueError("no keywords")
    groups: list[list[tuple[str, str]]] = [[]]
    size = 0
    for e in entries:
        size += len(e[0].encode()) + len(e[1].encode())
        if size > PHRASE_BYTES and groups[-1]:
            groups.append([])
            size = len(e[0].encode()) + len(e[1].encode())
        groups[-1].append(e)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.posexplode(leaves).alias("leaf", "text")).filter("text is not null")

    def searched(group: list[tuple[str, str]]) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(tuple(group))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for batch in batches:
                at, names = [], []
                for i, text in enumerate(batch.column(2)):
                    own = hits(text.as_py(), machine)
                    at += [i] * len(own)
                    names += own
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(names, pa.string())], names=["key", "leaf", "keyword"])

        return rows.mapInArrow(run, f"key {kind}, leaf int, keyword string")

    out = searched(groups[0])
    for group in groups[1:]:
        out = out.unionByName(searched(group))
    # a keyword's two names may lie in different groups
    out = out.distinct() if len(groups) > 1 else out
    return out.select(F.col("key").alias(key), "leaf", "keyword")

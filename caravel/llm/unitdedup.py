"""Substring dedup by hashing units: lines, paragraphs, and sentences of lines.

Units are normalised (A-Z lower-cased, white space between words ignored) and
their digests grouped globally.  The earliest occurrence by (doc, row, start)
stays, the others go; each keeps its place in the original text.  ``row`` is a
hash of doc and text, which tells texts of one doc id apart.  Kinds can be taken
together: then equal words are equal units, whatever their kinds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caravel.llm.setjoin import keyed, row_key
from caravel.llm.shingles import SPACE, U, buffers, chunks, mix, word_hashes, word_spans
from caravel.llm.store import holds, key_filter, lean, settle, tidy, touched

KINDS = ("paragraph", "line", "sentence")
_BASE = (U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F))


def unit_ends(text: np.ndarray, own: np.ndarray, kind: str) -> np.ndarray:
    """Places behind which a unit ends: texts' ends, newlines, empty lines, or marks that close a sentence."""
    feed = text == 10
    if kind == "paragraph":
        at = np.flatnonzero(feed[1:] & feed[:-1]) + 2
    elif kind == "line":
        at = np.flatnonzero(feed) + 1
    else:
        mark = (text == 46) | (text == 33) | (text == 63)
        behind = np.append(SPACE[text[1:]], True)
        at = np.flatnonzero(feed | (mark & behind)) + 1
    return np.unique(np.concatenate([at, own]))


def unit_rows(column: pa.Array, least: dict[str, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start, end, words, digest, digest2) arrays of the units of each kind's ``least`` words or more, some at a time.

    start and end count characters of the text, from the unit's first word to
    the end of its last.  What is a unit of several kinds is given once.
    """
    off, data = buffers(column)
    for i, j in chunks(off):
        own = off[i : j + 1] - off[i]
        text = data[off[i] : off[j]]
        start, end = word_spans(text, own, SPACE)
        if not len(start):
            continue
        h = word_hashes(text, start, end)
        chars = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        given = np.zeros(0, np.int64)
        for kind, fewest in least.items():
            ends = unit_ends(text, own, kind)
            unit = np.searchsorted(ends, start, "right")
            first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            n = np.diff(np.append(first, len(unit)))
            place = np.arange(len(h)) - np.repeat(first, n)
            digests = []
            for base in _BASE:
                power = np.cumprod(np.full(int(n.max()), base))
                digests.append(mix(np.add.reduceat(h * power[place], first) ^ n.astype(np.uint64)).view(np.int64))
            span = first * (len(h) + 1) + n
            keep = (n >= fewest) & ~np.isin(span, given)
            given = np.concatenate([given, span[keep]])
            first, n = first[keep], n[keep]
            row = np.searchsorted(own, start[first], "right") - 1
            base = chars[own[row]]
            yield row + i, chars[start[first]] - base, chars[end[first + n - 1]] - base, n, digests[0][keep], digests[1][keep]


def repeated_units(docs: DataFrame, doc: str, text: str, kind: str | dict[str, int] = "line", least: int = 5) -> DataFrame:
    """(doc, row, start, end, words, kept_doc, kept_row, kept_start): every unit that repeats an earlier one.

    ``kind`` is one kind, or the fewest words of each of several.  Of several,
    a repeat inside a larger repeat of its text isn't given, as that holds it.
    Units of fewer than ``least`` words stay; null and empty texts have none;
    texts of a null doc take no part.  Repeated rows (same doc, same text) have
    the same places, so their units repeat only what another text or place
    holds.  A first pass finds digests that occur more than once and keeps them
    in a filter sized to their number; the second pass takes the units that it
    lets through and groups them exactly.
    """
    kinds = kind if isinstance(kind, dict) else {kind: least}
    lean(docs.sparkSession)
    own = keyed(docs.filter(F.col(doc).isNotNull()), doc, text)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, d, _ in unit_rows(batch.column(0), kinds):
                yield pa.RecordBatch.from_arrays([pa.array(d)], names=["digest"])

    twice = settle(own.select("text").mapInArrow(tidy(digests), "digest long").groupBy("digest").count().filter("count > 1").select("digest"))
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(twice))

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, start, end, n, d, d2 in unit_rows(batch.column(2), kinds):
                hit = np.flatnonzero(holds(shared.value, d))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(at[hit])) for c in (0, 1)), *(pa.array(x[hit].astype(np.int64)) for x in (start, end, n, d, d2))], names=["doc", "row", "start", "end", "words", "digest", "digest2"]
                )

    units = settle(own.mapInArrow(tidy(through), "doc long, row long, start long, end long, words long, digest long, digest2 long"))
    place = ["doc", "row", "start"]
    first = units.groupBy("digest", "digest2").agg(F.min(F.struct(*place)).alias("x"), F.count("*").alias("n")).filter("n > 1")
    first = settle(first.select("digest", "digest2", *[F.col(f"x.{c}").alias(f"kept_{c}") for c in place]))
    later = units.join(first, ["digest", "digest2"]).filter("doc <> kept_doc or row <> kept_row or start <> kept_start")
    later = later.select("doc", "row", "start", "end", "words", *[f"kept_{c}" for c in place]).distinct()
    if len(kinds) == 1:
        return later
    # units nest: one lies in a larger repeat if a span before it, the longer first, reaches its end
    before = Window.partitionBy("doc", "row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return later.withColumn("_reach", F.max("end").over(before)).filter("_reach is null or _reach < end").drop("_reach")


def without_units(docs: DataFrame, doc: str, text: str, removed: DataFrame, changed_only: bool = False) -> DataFrame:
    """``docs``, or only its changed rows, with the removed (doc, row, start, end) spans cut out of ``text``; what else is in it stays as it is.

    Spans must not overlap, as those of ``repeated_units`` don't.  Only texts that may lose a span are shuffled.
    """
    spans = settle(removed.groupBy(F.col("doc").alias("k"), F.col("row").alias("r")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")))
    test = touched(docs.sparkSession, key_filter(spans.select("r")))
    row = row_key(doc, text)
    names = docs.columns
    own = docs.filter(test(row)).select(F.struct(*names).alias("d"), F.col(doc).cast("long").alias("k"), row.alias("r"))
    joined = own.join(spans, ["k", "r"], "inner" if changed_only else "left")
    old = F.col(f"d.{text}")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.char_length(old).cast("long")))
    kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substr(old, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    new = F.when(F.col("spans").isNull(), old).otherwise(F.array_join(kept, ""))
    made = joined.select(*[new.alias(c) if c == text else F.col(f"d.{c}").alias(c) for c in names])
    return made if changed_only else docs.filter(~test(row)).unionByName(made)

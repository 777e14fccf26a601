"""Quoted CSV of any size, read by many tasks.

A field in quotes may hold line feeds, so a line's meaning depends on how many
quotes stand before it in the file.  A first pass counts quotes and lines of
each block of the file, and how many records begin in it if it begins outside
or inside quotes; sums over the blocks before tell which holds and where the
numbers of its records begin.  The second pass puts the lines of each record
together where they lie; only records that reach over a block's end meet in a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caravel.session import settled

#: Blocks (a path and four numbers each) up to which their table is broadcast.
FEW_BLOCKS = 200_000


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array, np.ndarray, np.ndarray, int, int]]:
    """((path, block), lines, quotes of each, which are blank, from, to) of each stretch of a batch that is of one block."""
    path, block, value = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
    quotes = pc.count_substring(value, '"').to_numpy(zero_copy_only=False)
    blank = pc.is_in(value, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
    code = path.dictionary_encode().indices.to_numpy()
    cut = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1).tolist(), len(block)]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        if j > i:
            yield (path[i].as_py(), int(block[i])), value.slice(i, j - i), quotes[i:j], blank[i:j], i, j


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, quotes, outside, inside): quotes, and records that begin, by where the block begins."""
    total: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for at, _, quotes, blank, _, _ in _blocks(batch):
            own = total.setdefault(at, [0, 0, 0])
            before = (own[0] + np.cumsum(quotes) - quotes) % 2
            own[0] += int(quotes.sum())
            own[1] += int(((before == 0) & ~blank).sum())
            own[2] += int(((before == 1) & ~blank).sum())
    rows = [(*k, *v) for k, v in total.items()]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "block", "quotes", "outside", "inside"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, record, whole, text): the lines of each record that lie in a block, whole if it begins and ends there."""
    at, held, odd, number, began = None, [], 0, 0, False
    out: list[tuple] = []

    def close(whole: bool) -> None:
        if held:
            out.append((*at, number, whole and began, "\n".join(held)))
            held.clear()

    for batch in batches:
        starts_odd, first = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        for key, value, quotes, blank, i, _ in _blocks(batch):
            if key != at:
                close(odd == 0)
                at, odd, number, began = key, int(starts_odd[i]), int(first[i]) - 1, False
            before = (odd + np.cumsum(quotes) - quotes) % 2
            begins = (before == 0) & ~blank
            for line, new, outside in zip(value.to_pylist(), begins.tolist(), (before == 0).tolist(), strict=True):
                if new:
                    close(True)
                    number, began = number + 1, True
                    held.append(line)
                elif not outside:
                    held.append(line)
            odd = int((odd + quotes.sum()) % 2)
        if len(out) > 2_000:
            yield _rows(out)
            out = []
    close(odd == 0)
    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["path", "block", "record", "whole", "text"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, text): the records of quoted CSV files, numbered from 0 in each file, the head among them.

    Records end with a line feed outside quotes; blank lines there are none; a
    carriage return at a record's end and a byte order mark don't count.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    blocks = settled(lines.mapInArrow(_counted, "path string, block long, quotes long, outside long, inside long"))
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("odd", F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) % 2)
    blocks = blocks.withColumn("first", F.coalesce(F.sum(F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside"))).over(ahead), F.lit(0))).select("path", "block", "odd", "first")
    if blocks.count() > FEW_BLOCKS:
        raise ValueError(f"{path}: more than {FEW_BLOCKS} blocks; raise spark.sql.files.maxPartitionBytes")
    # the order of lines within a block must stay, so blocks are broadcast and no line moves
    pieces = lines.join(F.broadcast(blocks), ["path", "block"]).select("path", "block", "value", "odd", "first")
    made = pieces.mapInArrow(_joined, "path string, block long, record long, whole boolean, text string")
    split = made.filter("not whole").groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("x")).select("path", "record", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("text"))
    text = F.regexp_replace(F.when(F.col("record") == 0, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text")), r"\r$", "")
    return made.filter("whole").select("path", "record", "text").unionByName(split).select("path", "record", text.alias("text"))

"""Reports that arrive in chunks: lines are put together across micro-batches, then folded as if they had come at once."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caravel.functions import report

LINES = "request string, first long, lines array<string>, after_gap boolean"
STATE = "next long, line long, tail binary, held binary"


def stream_lines(chunks: DataFrame, patience: str | None = None) -> DataFrame:
    """(request, line, text, after_gap) of a stream of (request, seq, chunk, last).

    ``chunk`` is binary and may be cut anywhere, within a line or a character;
    ``seq`` counts from 0; ``last`` marks the end, whose unfinished line is
    given too.  A chunk that came before is ignored; one that is ahead of its
    time is held until what is missing has come.  With ``patience`` a request
    that is silent so long is given up: what is held is put in order behind the
    gap, and the lines from there on are marked ``after_gap``.  State is kept
    by request: the unfinished line, and what is held.

    A request costs a task milliseconds for each column and frame, so a chunk
    comes as one value, and its request's new lines leave as one row.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place, line, tail, held = 0, 0, b"", {}
        if state.exists:
            place, line, tail, packed = state.get
            tail, held = bytes(tail), pickle.loads(bytes(packed))
        gap = over = state.hasTimedOut
        ready = [tail]
        if over:
            ready += [held[seq][0] for seq in sorted(held)]
        else:
            for frame in frames:
                for packed in frame["packed"]:
                    seq, last, chunk = packed.split(b" ", 2)
                    if int(seq) >= place:
                        held.setdefault(int(seq), (chunk, last == b"1"))
            while place in held and not over:
                data, over = held.pop(place)
                ready.append(data)
                place += 1
        *full, tail = b"".join(ready).split(b"\n")
        if over:
            full += [tail] if tail else []
            place, tail, held = 2**62, b"", {}  # whatever comes after the end is ignored
        state.update((place, line + len(full), tail, pickle.dumps(held)))
        if patience and not over:
            state.setTimeoutDuration(_milliseconds(patience))
        if full:
            yield pd.DataFrame({"request": [key[0]], "first": [line], "lines": [[x.decode("utf-8", "replace") for x in full]], "after_gap": [gap]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout
    head = F.concat(F.col("seq").cast("string"), F.when(F.col("last"), " 1 ").otherwise(" 0 "))
    own = chunks.filter("seq IS NOT NULL").select("request", F.concat(F.encode(head, "utf-8"), F.coalesce("chunk", F.lit(b""))).alias("packed"))
    found = own.groupBy("request").applyInPandasWithState(run, LINES, STATE, "append", timeout)
    return found.select("request", "first", "after_gap", F.posexplode("lines").alias("at", "text")).select("request", (F.col("first") + F.col("at")).alias("line"), "text", "after_gap")


def _milliseconds(text: str) -> int:
    number, unit = text.split()
    return int(float(number) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])


def folded_reports(lines: DataFrame) -> DataFrame:
    """(request, payloads, report, after_gap) of ``stream_lines``: what folding each request's whole text at once gives."""
    rows = lines.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("x"), F.max("after_gap").alias("after_gap"))
    text = F.array_join(F.transform("x", lambda x: x["text"]), "\n")
    rows = rows.select("request", report.events_of(text).alias("p"), "after_gap")
    return rows.select("request", F.size("p").alias("payloads"), report.folded(F.col("p")).alias("report"), "after_gap")

"""Alignment of two tokenizers over a corpus.

A text's tokens by A (byte-level) and by B (pieces) cover the same bytes.
Where tokens of both end, the text is cut into groups; a token of A and one of
B are linked where their bytes overlap.  How many documents hold a pair of ids
linked is counted over the whole corpus, and each document is scored by the
counts of its links.

Pairs are packed into one 64-bit key each, A's id above B's.  Tasks count their
documents' distinct keys with ``np.unique``; the partial counts are dealt out
by ranges of keys and sorted, equal keys are runs whose counts are summed, and
every range is written to the shared folder as a shard of sorted keys and
counts.  Tasks that score documents map the shards into memory and look their
keys up by binary search.  Besides the shards' names only A's highest counts
pass the driver, one for each id of its vocabulary.

Texts that are null or empty, or whose tokens don't give back a space and the
text (as where a text holds U+2581), have no tokens: zeros and an empty string.
Each row of the table is a document, also where ids repeat or are null.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.llm.store import ensure_checkpoint_dir, lean, mapped, partitions, shared_file, tidy
from caravel.llm.tokens import RANKS, _fast, place

PIECES = "piece_bpe_32k.model"
SHIFT = 32
#: Keys that a task holds before it counts them, looks them up or hands partial counts on.
HELD_KEYS = 1 << 22


@functools.lru_cache(maxsize=2)
def _bytes_of_ranks(ranks: str) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each id of A, and how many they are."""
    with open(ranks, "rb") as f:
        found = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    table = [found.get(i, b"") for i in range(max(found) + 1)]
    return table, np.array([len(x) for x in table])


@functools.lru_cache(maxsize=2)
def _pieces(model: str):
    """B, the bytes of each of its ids, and how many they are."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model)
    table = [bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode() for i in range(own.get_piece_size())]
    return own, table, np.array([len(x) for x in table])


@functools.lru_cache(maxsize=1)
def _written(size: int) -> list[bytes]:
    """Each id below ``size`` in decimal, with each mark that may stand behind it."""
    return [b"%d%s" % (i, mark) for i in range(size) for mark in (b",", b"|", b";")]


def tokens_of(text: str, ranks: str, model: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(A's ids, B's ids, where A's tokens end, where B's end) in the bytes of a space and the text; None without tokens."""
    if not text:
        return None
    whole = " " + text
    table_a, size_a = _bytes_of_ranks(ranks)
    own, table_b, size_b = _pieces(model)
    a, pieces = _fast(ranks).encode_to_numpy(whole, disallowed_special=()).astype(np.int64), own.encode(text)
    bytes_ = whole.encode()
    if b"".join(map(table_b.__getitem__, pieces)) != bytes_ or b"".join(map(table_a.__getitem__, a.tolist())) != bytes_:
        return None
    b = np.array(pieces, np.int64)
    return a, b, np.cumsum(size_a[a]), np.cumsum(size_b[b])


def marks(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in the text whether a token of A, and one of B, ends there."""
    in_a, in_b = np.zeros((2, int(end_a[-1]) + 1), bool)
    in_a[end_a] = in_b[end_b] = True
    return in_a, in_b


def links_of(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> np.ndarray:
    """Packed keys of all links: each stretch between neighbouring ends lies in one token of either side."""
    ends = np.flatnonzero(in_a | in_b)
    # the token that ends here or later is the one after those that ended before
    at_a, at_b = (np.cumsum(x, dtype=np.int32)[ends] - x[ends] for x in (in_a, in_b))
    return a[at_a] << SHIFT | b[at_b]


def groups_of(a: np.ndarray, b: np.ndarray, closes_a: np.ndarray, closes_b: np.ndarray) -> tuple[int, bytes]:
    """(number of groups, groups as ``a1,a2|b1;a3|b2,b3``), from which tokens end where one of the other side does."""
    # the group of each token, and how many of the other side's tokens are written before it
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    last_a, last_b = np.flatnonzero(closes_a) + 1, np.flatnonzero(closes_b) + 1
    line = np.empty(len(a) + len(b), np.int64)
    line[np.arange(len(a)) + np.append(0, last_b)[group_a]] = a * 3 + closes_a
    line[np.arange(len(b)) + last_a[group_b]] = b * 3 + 2 * closes_b
    return len(last_a), b"".join(map(_written(1 << 16).__getitem__, line.tolist()))[:-1]


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys by their steps, each byte of them beside those of its place: small once compressed."""
    return np.diff(keys, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view("<i8").ravel())


DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def document_links(docs: DataFrame, doc: str, text: str, ranks: str | None = None, model: str | None = None, groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times) of every row: its distinct packed keys and how many links each has; with ``groups`` their text too."""
    lean(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ranks or place(RANKS), model or place(PIECES)  # found where the task runs
        for batch in batches:
            out = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = tokens_of(t.as_py(), *files)
                if found is None:
                    out.append((d, 0, 0, 0, 0, "", b"", b"", ""))
                    continue
                a, b, end_a, end_b = found
                in_a, in_b = marks(end_a, end_b)
                keys, times = np.unique(links := links_of(a, b, in_a, in_b), return_counts=True)
                n, said = groups_of(a, b, in_b[end_a], in_a[end_b])
                out.append((d, len(found[0]), len(found[1]), n, len(links), hashlib.sha256(said).hexdigest(), pack(keys), times.astype("<u4").tobytes(), said.decode() if groups else ""))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            columns = columns if groups else columns[:-1]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [c.split()[0] for c in DOCUMENT.split(", ")] + ["keys", "times"] + ["groups"] * groups
    return docs.select(F.col(doc).cast("long").alias("doc_id"), text).mapInArrow(tidy(run), DOCUMENT + ", keys binary, times binary" + ", groups string" * groups)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys once each, with the sums of their runs."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def partial_counts(rows: DataFrame) -> DataFrame:
    """(key, n): how many of a task's documents hold each key; a task hands on what it has when its table is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        keys = n = np.zeros(0, np.int64)

        def fold() -> tuple[np.ndarray, np.ndarray]:
            fresh, times = np.unique(np.concatenate(held), return_counts=True)
            both = np.concatenate([keys, fresh])
            order = np.argsort(both, kind="stable")
            return _summed(both[order], np.concatenate([n, times])[order])

        for batch in batches:
            held += [unpack(x.as_py()) for x in batch.column(0)]
            if sum(map(len, held)) >= HELD_KEYS:
                keys, n = fold()
                held = []
            if len(keys) >= HELD_KEYS:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
                keys = n = np.zeros(0, np.int64)
        if held:
            keys, n = fold()
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], names=["key", "n"])

    return rows.select("keys").mapInArrow(tidy(run), "key long, n long")


def write_shards(partial: DataFrame, folder: str, tasks: int) -> tuple[list[tuple[str, int]], np.ndarray]:
    """Write the sorted counts; (file name, first key) of each shard in order, and A's highest count by id.

    A task that runs twice writes files of other names; those whose row is
    returned are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/shard-{uuid.uuid4().hex}"
        files = [shared_file(f"{name}.{kind}") for kind in ("keys", "counts")]
        first, best = None, {}
        with files[0][0].open_output_stream(files[0][1]) as keys_file, files[1][0].open_output_stream(files[1][1]) as counts_file:

            def put(keys: np.ndarray, n: np.ndarray) -> None:
                keys_file.write(keys.astype("<i8").tobytes())
                counts_file.write(n.astype("<i8").tobytes())
                ids, at = np.unique(keys >> SHIFT, return_index=True)
                for a, x in zip(ids.tolist(), np.maximum.reduceat(n, at).tolist(), strict=True):
                    best[a] = max(best.get(a, 0), x)

            last = np.zeros(0, np.int64), np.zeros(0, np.int64)  # its run may go on in the next batch
            for batch in batches:
                if not len(batch):
                    continue
                keys, n = _summed(np.concatenate([last[0], batch.column(0).to_numpy()]), np.concatenate([last[1], batch.column(1).to_numpy()]))
                first = int(keys[0]) if first is None else first
                if len(keys) > 1:
                    put(keys[:-1], n[:-1])
                last = keys[-1:], n[-1:]
            if len(last[0]):
                put(*last)
        if first is not None:
            pairs = np.array(list(best.items()), "<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([pairs], pa.binary())], names=["name", "first", "best"])

    system, path = shared_file(folder)
    system.create_dir(path, recursive=True)
    dealt = partial.repartitionByRange(tasks, "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(tidy(run), "name string, first long, best binary").collect()
    best = np.zeros(1 << 16, np.int64)
    for _, _, pairs in found:
        ids, n = np.frombuffer(pairs, "<i8").reshape(-1, 2).T
        if len(ids) and int(ids.max()) >= len(best):
            best = np.append(best, np.zeros(int(ids.max()) + 1 - len(best), np.int64))
        np.maximum.at(best, ids, n)
    return sorted(((r[0], r[1]) for r in found), key=lambda x: x[1]), best


def look_up(keys: np.ndarray, shards: list[tuple[str, int]]) -> np.ndarray:
    """The counts of sorted keys, shard by shard."""
    cut = np.searchsorted(keys, [first for _, first in shards]).tolist() + [len(keys)]
    out = np.zeros(len(keys), np.int64)
    for (name, _), i, j in zip(shards, cut[:-1], cut[1:], strict=True):
        if i < j:
            out[i:j] = mapped(f"{name}.counts")[np.searchsorted(mapped(f"{name}.keys"), keys[i:j])]
    return out


def score_links(rows: DataFrame, shards: list[tuple[str, int]], best: np.ndarray) -> DataFrame:
    """``document_links`` with n_best and count_sum instead of the keys."""
    shared = rows.sparkSession.sparkContext.broadcast((shards, best))
    names = [c.split()[0] for c in DOCUMENT.split(", ")]

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        shards, best = shared.value
        keys = [unpack(x.as_py()) for x in batch.column(len(names))]
        size = np.array([len(k) for k in keys])
        who = np.repeat(np.arange(len(keys)), size)
        times = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in batch.column(len(names) + 1)]).astype(np.int64)
        own, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = look_up(own, shards)[back]
        top = count == best[own >> SHIFT][back]
        add = lambda x: pa.array(_by_row(who, x, len(keys)))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], add(times * top), add(times * count)], names=[*names, "n_best", "count_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += batch.column(len(names)).nbytes // 8
            if n >= HELD_KEYS:
                yield scored(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, n = [], 0
        if held:
            yield scored(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.select(*names, "keys", "times").mapInArrow(tidy(run), DOCUMENT + ", n_best long, count_sum long")


def _by_row(who: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by row; rows are in order."""
    run = np.append(0, np.cumsum(x))
    edge = np.searchsorted(who, np.arange(n + 1))
    return run[edge[1:]] - run[edge[:-1]]


def alignment(docs: DataFrame, doc: str, text: str, ranks: str | None = None, model: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row of ``docs``."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/align-{uuid.uuid4().hex}"
    document_links(docs, doc, text, ranks, model).write.option("compression", "zstd").parquet(f"{folder}/documents")
    rows = spark.read.parquet(f"{folder}/documents")
    shards, best = write_shards(partial_counts(rows), f"{folder}/shards", partitions(spark))
    return score_links(rows, shards, best)

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of neighbouring
words, and of words with one word between them; longer words also count by
their first ``STEMS`` bytes, so that inflected forms share a feature.  Words are runs of characters
other than white space and ASCII punctuation marks, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caravel.llm.shingles import U, buffers, chunks, mix, word_hashes, word_spans
from caravel.llm.store import lean, settle, tidy

BITS = 20
#: Most labelled documents that training reads; the sample is those of least hash of doc_id.
SAMPLE = 12_000
#: Most bytes of features that training reads: documents are taken in the order of the sample, each with all its
#: features, while they fit; the first is always taken.
SAMPLE_BYTES = 256 << 20
THRESHOLD = 0.7
STEMS = (5, 6, 7)

#: Separators: all ASCII characters that are neither letters nor digits.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = True
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def feature_arrays(column: pa.Array, weights: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each text its distinct feature numbers; only those with a weight, if weights are given."""
    off, data = buffers(column)
    cells = U((1 << BITS) - 1)
    for i, j in chunks(off):
        own = off[i : j + 1] - off[i]
        text = data[off[i] : off[j]]
        start, end = word_spans(text, own, PUNCTUATION)
        h = word_hashes(text, start, end)
        owner = np.searchsorted(own, start, "right") - 1
        parts, owners = [h], [owner]
        for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0x9E6C63D0876A9A35)):
            if len(h) > gap:
                same = owner[gap:] == owner[:-gap]
                parts.append(mix(h[:-gap] * U(salt) + h[gap:])[same])
                owners.append(owner[gap:][same])
        for size in STEMS:
            long = np.flatnonzero(end - start > size)
            parts.append(mix(word_hashes(text, start[long], start[long] + size) + U(size)))
            owners.append(owner[long])
        number = (np.concatenate(parts) & cells).astype(np.int64)
        who = np.concatenate(owners)
        if weights is not None:
            live = weights[number] != 0
            number, who = number[live], who[live]
        key = np.unique(who << BITS | number)
        bounds = np.searchsorted(key, np.arange(j - i + 1) << BITS)
        number = key & ((1 << BITS) - 1)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield number[a:b]


def ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = 6, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) after proximal steps with a rate of its own for each coordinate."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = bias = 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = rows[i]
            own, seen = z[x], n[x]
            w = np.where(np.abs(own) <= l1, 0.0, (np.sign(own) * l1 - own) / ((beta + np.sqrt(seen)) / alpha + l2))
            bias = -bias_z / ((beta + bias_n**0.5) / alpha) if bias_n else 0.0
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - labels[i]
            step = (np.sqrt(seen + g * g) - np.sqrt(seen)) / alpha
            z[x] = own + g - step * w
            n[x] = seen + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha * bias
            bias_n += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w.astype(np.float32), float(-bias_z / ((beta + bias_n**0.5) / alpha)) if bias_n else 0.0


def held_out(doc: str):
    """Whether a document is kept from training: crc32 of its id as text, mod 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, doc: str, text: str, labels: DataFrame, label_doc: str, label: str, sample: int = SAMPLE, epochs: int = 6) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample`` labelled documents that aren't held out; without both classes the bias says all.

    A document whose labels differ counts as toxic; of rows that repeat an id
    each text is learnt from.  What goes to the one training task is bounded by
    ``sample`` and ``SAMPLE_BYTES``; what is learnt from is whole texts.
    """
    lean(docs.sparkSession)
    known = labels.filter(F.col(label_doc).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label_doc).cast("long").alias("_doc")).agg(F.max(label).cast("int").alias("_label"))
    known = known.filter(~held_out("_doc")).orderBy(F.xxhash64("_doc"), "_doc").limit(sample)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x.astype(np.int32).tobytes() for x in feature_arrays(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc", "label", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (r[0], r[2]))
        w, bias = ftrl([np.frombuffer(r[2], np.int32) for r in rows], np.array([float(r[1]) for r in rows]), epochs=epochs)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at].astype(float), bias))], names=["at", "w"])

    own = docs.select(F.col(doc).cast("long").alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(known), "_doc").select("_doc", "_label", "_text")
    made = settle(own.mapInArrow(tidy(featurise), "doc long, label int, x binary"))
    sizes = made.select("doc", F.octet_length("x").alias("size")).groupBy("doc").agg(F.sum("size").alias("size")).orderBy(F.xxhash64("doc"), "doc").collect()
    total = np.cumsum([r["size"] for r in sizes])
    if len(total) and total[-1] > SAMPLE_BYTES:  # the documents of a sample are at most ``sample``
        taken = [r["doc"] for r in sizes[: max(1, int(np.searchsorted(total, SAMPLE_BYTES, "right")))]]
        made = made.join(F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in taken], "doc long")), "doc", "left_semi")
    rows = made.repartition(1).mapInArrow(tidy(fit), "at long, w double").collect()
    weights, bias = np.zeros(1 << BITS, np.float32), 0.0
    for at, w in rows:
        if at < 0:
            bias = w
        else:
            weights[at] = w
    return weights, bias


def score(docs: DataFrame, text: str, model: tuple[np.ndarray, float], into: str = "score") -> DataFrame:
    """``docs`` and the score of each whole text, 0 to 1; a null text counts as empty."""
    weights, bias = model
    at = np.flatnonzero(weights)
    shared = lean(docs.sparkSession).sparkContext.broadcast((at, weights[at], bias))
    keep = [c for c in docs.columns if c != into]
    where = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, bias = shared.value
        table = np.zeros(1 << BITS, np.float32)
        table[at] = own
        for batch in batches:
            total = np.array([float(table[x].sum(dtype=np.float64)) for x in feature_arrays(batch.column(where), table)]) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())], names=[*keep, into])

    rows = docs.select(*keep)
    return rows.mapInArrow(tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{into}` double")

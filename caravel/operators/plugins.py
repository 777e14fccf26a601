"""Encoders, judges and generators plug in here; the defaults need no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    dims: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Judge(Protocol):
    def text(self, prompt: str, max_new_tokens: int) -> str | tuple[str, bool]:
        """The answer, or the answer and whether it was cut at the limit."""
        ...


class HashingEncoder:
    """Unit vectors of signed word counts; equal texts have equal vectors everywhere."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dims] += 1.0 if h >> 63 else -1.0
            size = np.linalg.norm(row)
            row[:] = row / size if size else np.eye(1, self.dims, dtype=np.float32)[0]
        return out


def encoded(df: DataFrame, text: str, encoder: Encoder | None = None, into: str = "embedding") -> DataFrame:
    """``df`` with the vector of each text; a task makes batches with one encoder."""
    encoder = encoder or HashingEncoder()
    keep = [c for c in df.columns if c != into]
    at = keep.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = encoder.encode([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(rows), pa.list_(pa.float32()))], names=[*keep, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return df.select(*keep).mapInArrow(run, f"{fields}, `{into}` array<float>")


def signature(**config) -> str:
    """Fingerprint of a configuration; an index is only opened under its own."""
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def generation_fingerprint(data: str, tests: str, model: dict, settings: dict, prompts: dict, versions: dict, adapter: dict | None = None, top_k: int = 0, encoder: dict | None = None, knowledge: str | None = None, index: dict | None = None) -> str:
    """Fingerprint of everything that a generation depends on; settings of scoring don't belong to it.

    ``data``, ``tests`` and ``knowledge`` are digests of rows (``ordered_digest``).
    Encoder, knowledge and index count only if something is retrieved (``top_k``),
    versions of an adapter's library only with an adapter.
    """
    own = {"data": data, "tests": tests, "model": model, "settings": settings, "prompts": prompts, "top_k": top_k, "adapter": adapter}
    own["versions"] = {k: v for k, v in versions.items() if adapter is not None or k != "adapter"}
    if top_k:
        own |= {"encoder": encoder, "knowledge": knowledge, "index": index}
    return signature(**own)


def selection_key(data: str, reserved: str, seed: int, count: int | None = None, knowledge: int | None = None, kinds: list[str] | None = None, shared: str | None = None) -> str:
    """Fingerprint of a choice of test and knowledge rows (``evaluation_split``): runs with equal keys can share them.  ``data`` and ``reserved`` are digests of rows."""
    return signature(data=data, reserved=reserved, seed=seed, count=count, knowledge=knowledge, kinds=sorted(kinds) if kinds else None, shared=shared)


def add_missing(index: DataFrame, samples: DataFrame, key: str, text: str, encoder: Encoder | None = None) -> DataFrame:
    """Rows to append to an index: samples whose key it hasn't, encoded once."""
    fresh = samples.dropDuplicates([key]).join(index.select(key), key, "left_anti")
    return encoded(fresh, text, encoder)


def supported_share(verdicts: DataFrame, key: str, supported: str, good: str) -> DataFrame:
    """Supported claims over all; null for a row of which any batch failed."""
    return verdicts.groupBy(key).agg(F.when(F.every(good), F.avg(F.col(supported).cast("double"))).alias("factscore"))

"""Tokens of texts and scores of text pairs, on whole Arrow batches.

Tokens are runs of word characters, lower-cased; runs of CJK characters are cut
into words: by a dictionary counted from a corpus where one is given, along the
path of greatest probability through the graph of its words, else character by
character.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: CJK ideographs, of which each is a word unless a dictionary knows better.
CJK = "㐀-䶿一-鿿豈-﫿"
_RUNS = f"[{CJK}]+|[\\p{{L}}\\p{{M}}\\p{{N}}_&&[^{CJK}]]+"
_TOKENS = f"[{CJK}]|[\\p{{L}}\\p{{M}}\\p{{N}}_&&[^{CJK}]]+"


def tokens(text: Column) -> Column:
    """CJK characters one by one, other word characters in runs, lower-cased; none for a null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(_TOKENS), F.lit(0)), F.array().cast("array<string>"))


# words of a dictionary


def counted_words(docs: DataFrame, text: str, longest: int = 4, least: int = 5) -> DataFrame:
    """(word, n): runs of 1 to ``longest`` CJK characters within longer runs, that occur ``least`` times or more; single ones always."""
    runs = docs.select(F.explode(F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))).alias("run"))
    runs = runs.groupBy("run").count()  # a run that is said often is cut once
    spans = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.char_length("run")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda k: F.when(i + k - 1 <= F.char_length("run"), F.substr("run", i, k))))), lambda w: w.isNotNull())
    words = runs.select(F.explode(spans).alias("word"), "count").groupBy("word").agg(F.sum("count").alias("n"))
    return words.filter((F.col("n") >= least) | (F.char_length("word") == 1))


#: Most words of a dictionary that tasks are handed; the most frequent stay.
MOST_WORDS = 500_000


@dataclass(frozen=True)
class Dictionary:
    """Words with the logarithms of their probabilities."""

    words: tuple[str, ...]
    logs: tuple[float, ...]
    unknown: float
    longest: int

    @classmethod
    def of(cls, counted: DataFrame, most: int = MOST_WORDS) -> Dictionary:
        """From (word, n) rows; beyond ``most`` words the rarer ones are left out, which ``most`` bounds on the driver."""
        rows = counted.orderBy(F.desc("n"), "word").limit(most).collect()
        total = sum(r["n"] for r in rows) or 1
        return cls(tuple(r["word"] for r in rows), tuple(math.log(r["n"] / total) for r in rows), math.log(1 / total), max((len(r["word"]) for r in rows), default=1))


def best_cuts(run: list[str], dictionary: Dictionary) -> list[list[str]]:
    """The words of each run along its most probable path; of equal paths the one of longer first words.

    All runs go in step from their ends, a character at a time; single
    characters that the dictionary hasn't are as probable as one occurrence.
    """
    size = np.array([len(r) for r in run], np.int64)
    if not len(size):
        return []
    start = np.append(0, np.cumsum(size))
    flat = "".join(run)
    n = len(flat)
    known = pa.array(dictionary.words, pa.string())
    logs = np.array([*dictionary.logs, -np.inf])
    left = np.repeat(start[1:], size) - np.arange(n)  # characters from here to the run's end
    score = np.full((dictionary.longest, n), -np.inf)
    for k in range(1, dictionary.longest + 1):
        at = np.flatnonzero(left >= k)
        spans = pa.array([flat[i : i + k] for i in at.tolist()], pa.string())
        place = pc.fill_null(pc.index_in(spans, value_set=known), len(dictionary.words)).to_numpy(zero_copy_only=False)
        score[k - 1, at] = logs[place]
    score[0] = np.maximum(score[0], dictionary.unknown)
    best = np.zeros(n + 1)
    step = np.ones(n, np.int64)
    order = np.argsort(left, kind="stable")
    cut = np.searchsorted(left[order], np.arange(1, int(size.max()) + 2))
    for d in range(int(size.max())):
        here = order[cut[d] : cut[d + 1]]  # d characters follow in their runs
        value = np.full(len(here), -np.inf)
        for k in range(1, min(dictionary.longest, d + 1) + 1):
            rest = np.where(left[here] > k, best[here + k], 0.0)
            new = score[k - 1, here] + rest
            better = new >= value - 1e-12
            value = np.where(better, new, value)
            step[here[better]] = k
        best[here] = value
    out = []
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        words = []
        while a < b:
            words.append(flat[a : a + step[a]])
            a += int(step[a])
        out.append(words)
    return out


def segmenter(dictionary: Dictionary) -> Callable[[Column], Column]:
    """A function that makes columns of tokens: words of the dictionary within CJK runs, other runs as they are, lower-cased."""
    cjk = f"^[{CJK}]"

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(runs: pa.Array) -> pa.Array:
        flat = runs.flatten().to_pylist()
        sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
        han = [i for i, r in enumerate(flat) if "㐀" <= r[0] <= "﫿" and pc.match_substring_regex(pa.array([r[0]]), cjk)[0].as_py()]
        found: list[list[str]] = [[r] for r in flat]
        for i, words in zip(han, best_cuts([flat[i] for i in han], dictionary), strict=True):
            found[i] = words
        ends = np.append(0, np.cumsum(sizes))
        return pa.array([[w for ws in found[a:b] for w in ws] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.string()))

    return lambda text: cut(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(_RUNS), F.lit(0)), F.array().cast("array<string>")))


# scores


def _codes(*columns: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, code) of the tokens of each list column; equal tokens of any column have one code."""
    flat = pa.concat_arrays([c.flatten().cast(pa.string()) for c in columns])
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out, at = [], 0
    for c in columns:
        size = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = int(size.sum())
        out.append((np.repeat(np.arange(len(size)), size), code[at : at + n]))
        at += n
    return out


def _grams(row: np.ndarray, code: np.ndarray, gram: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n-1-grams (first token, code) those that another token of their row follows, and the pairs of both."""
    inside = (first + n - 1 < len(code)) & (row[np.minimum(first + n - 1, len(code) - 1)] == row[first]) if len(code) else np.zeros(0, bool)
    at = first[inside]
    return at, np.stack([gram[inside], code[at + n - 1]], axis=1) if len(at) else np.zeros((0, 2), np.int64)


def bleu4(prediction: pa.Array, reference: pa.Array, smooth: bool = False) -> np.ndarray:
    """BLEU of rows of tokens: up to four, equal weights, brevity penalty; 0 for an empty side or, unsmoothed, a precision of 0."""
    sides = _codes(prediction, reference)
    n_rows = len(prediction)
    sizes = [np.bincount(row, minlength=n_rows) for row, _ in sides]
    logs, dead = np.zeros(n_rows), (sizes[0] == 0) | (sizes[1] == 0)
    grams = [(np.arange(len(code)), code) for _, code in sides]
    for n in range(1, 5):
        if n > 1:
            pairs = [_grams(row, code, gram, first, n) for (row, code), (first, gram) in zip(sides, grams, strict=True)]
            both = np.concatenate([p for _, p in pairs])
            _, number = np.unique(both, axis=0, return_inverse=True) if len(both) else (None, np.zeros(0, np.int64))
            cut = len(pairs[0][0])
            grams = [(pairs[0][0], number.ravel()[:cut]), (pairs[1][0], number.ravel()[cut:])]
        most = max((int(g.max()) for _, g in grams if len(g)), default=0) + 1
        keys = [sides[s][0][grams[s][0]] * most + grams[s][1] for s in (0, 1)]
        (a, in_a), (b, in_b) = (np.unique(k, return_counts=True) for k in keys)
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        hit = np.bincount(a[i] // most, np.minimum(in_a[i], in_b[j]), minlength=n_rows)[:n_rows]
        total = np.maximum(1, sizes[0] - n + 1)
        none = hit == 0
        dead |= none if not smooth or n == 1 else False
        logs += np.log(np.where(none, 0.1, hit) / total) / 4
    brevity = np.where(sizes[0] > sizes[1], 0.0, 1 - sizes[1] / np.maximum(sizes[0], 1))
    return np.where(dead, 0.0, np.exp(logs + brevity))


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence: one row of the table as bits, a step for each token of ``b``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(prediction: pa.Array, reference: pa.Array) -> np.ndarray:
    """F1 of the longest common subsequence of rows of tokens."""
    (row_a, a), (row_b, b) = _codes(prediction, reference)
    edge = np.arange(len(prediction) + 1)
    cut_a, cut_b = np.searchsorted(row_a, edge), np.searchsorted(row_b, edge)
    out = np.zeros(len(prediction))
    for i in np.flatnonzero((np.diff(cut_a) > 0) & (np.diff(cut_b) > 0)).tolist():
        x, y = a[cut_a[i] : cut_a[i + 1]], b[cut_b[i] : cut_b[i + 1]]
        out[i] = 2 * common_length(x, y) / (len(x) + len(y))
    return out


def bare_text(text: Column) -> Column:
    """Text without thoughts, white space and signs, lower-cased; empty for a null."""
    rest = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.coalesce(F.lower(F.regexp_replace(rest, r"[^\p{L}\p{M}\p{N}]+", "")), F.lit(""))


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of the matching blocks of two ``bare_text`` columns; 1 for two empty texts, 0 for one."""
    ratio = lambda x, y: float(x == y) if not x or not y else difflib.SequenceMatcher(None, x, y).ratio()
    return pa.array([ratio(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def bleu_score(prediction: pa.Array, reference: pa.Array) -> pa.Array:
    """BLEU-4 of columns of tokens."""
    return pa.array(bleu4(prediction, reference))


@F.arrow_udf(T.DoubleType())
def smooth_bleu_score(prediction: pa.Array, reference: pa.Array) -> pa.Array:
    """BLEU-4 of columns of tokens, in which 0.1 stands for no hit of two tokens or more."""
    return pa.array(bleu4(prediction, reference, smooth=True))


@F.arrow_udf(T.DoubleType())
def rouge_score(prediction: pa.Array, reference: pa.Array) -> pa.Array:
    """ROUGE-L of columns of tokens."""
    return pa.array(rouge_l(prediction, reference))

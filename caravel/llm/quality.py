"""Quality rules: decision lists learnt by sequential covering over statistics of whole texts.

Statistics are counts over a text's words, lines and characters; measures are
their ratios, as Spark columns.  A rule is a conjunction of thresholds on
measures.  Rules are learnt one after another from labelled rows: each is grown
condition by condition on two thirds of the rows still uncovered, pruned on the
other third, and takes the rows that it covers with it.  The list becomes one
ordered conditional expression: the number of the first rule that holds, 0 if
none does.

Words are runs of characters other than white space; case counts.  A line is
what ``\\n`` separates.  A null text has the statistics of an empty one, all 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravel.llm.shingles import EXACT, SPACE, buffers, chunks, shingle_hashes, word_hashes, word_spans
from caravel.llm.store import lean, tidy
from caravel.llm.toxicity import held_out

#: Most labelled documents that rules are learnt from; the sample is those of least hash of doc_id.
SAMPLE = 20_000
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_text_chars", "n_upper", "n_lower", "n_digits", "n_marks", "n_closed_lines")


def _class(*codes: int | str) -> np.ndarray:
    out = np.zeros(256, bool)
    for c in codes:
        out[[ord(x) for x in c] if isinstance(c, str) else c] = True
    return out


_SYMBOL, _MARK, _CLOSE = _class(SYMBOLS), _class("!?"), _class(".!?:;\"')")
_UPPER, _LOWER, _DIGIT = _class(*range(65, 91)), _class(*range(97, 123)), _class(*range(48, 58))
#: Bytes that go on a character: not counted as characters of their own.
_GOES_ON = _class(*range(0x80, 0xC0))


def _repeated(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (owner, key): whether the pair occurs more than once, and whether it is its first occurrence."""
    order = np.lexsort((keys, owner))  # stable: equal pairs stay in their order
    same = (owner[order][1:] == owner[order][:-1]) & (keys[order][1:] == keys[order][:-1])
    many, first = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    many[order[1:][same]] = many[order[:-1][same]] = True
    first[order[1:][same]] = False
    return many, first


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; lines and windows are compared by 64-bit hashes."""
    off, data = buffers(column)
    out = np.zeros((len(off) - 1, len(STATISTICS)), np.int64)
    for i, j in chunks(off):
        own, text = off[i : j + 1] - off[i], data[off[i] : off[j]]
        n = j - i
        start, end = word_spans(text, own, SPACE)
        owner = np.searchsorted(own, start, "right") - 1
        words = word_hashes(text, start, end, EXACT)
        count = lambda who, some=None: np.bincount(who if some is None else who[some], minlength=n)[:n]
        # running counts of a class of bytes give its number within any text
        within = lambda kind: np.diff(np.append(0, np.cumsum(kind[text]))[own])
        spaces = within(SPACE)
        chars = np.diff(own) - within(_GOES_ON)
        covered = np.zeros(len(words), bool)
        if len(words) > 2:
            windows = shingle_hashes(words, 3)
            inside = np.flatnonzero(owner[2:] == owner[:-2])
            many, _ = _repeated(owner[inside], windows[inside])
            for k in range(3):
                covered[inside[many] + k] = True
        # lines end before each \n and at each text's end
        cut = np.flatnonzero(text == 10)
        line_end = np.sort(np.append(cut, own[1:]), kind="stable")
        line_owner = np.append(np.searchsorted(own, cut, "right") - 1, np.arange(n))
        line_owner = np.sort(line_owner)
        line_start = np.append(0, line_end[:-1] + 1)
        first = np.append(True, line_owner[1:] != line_owner[:-1])
        line_start[first] = own[:-1][line_owner[first]]
        lettered = np.append(0, np.cumsum(~SPACE[text]))
        full = lettered[line_end] > lettered[line_start]
        a, b, who = line_start[full], line_end[full], line_owner[full]
        _, new = _repeated(who, word_hashes(text, a, b, EXACT))
        # the last character of a line that isn't white space is the end of its last word
        last = text[end[np.searchsorted(end, b, "right") - 1] - 1] if len(b) else np.zeros(0, np.uint8)
        table = (count(owner), chars - spaces, within(_SYMBOL), count(who, ~new), count(owner, covered), count(who), chars, within(_UPPER), within(_LOWER), within(_DIGIT), within(_MARK), count(who, _CLOSE[last]))
        out[i:j] = np.stack(table, axis=1)
    return out


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` and its texts' ``STATISTICS`` (long); columns of these names are replaced."""
    lean(docs.sparkSession)
    keep = [c for c in docs.columns if c not in STATISTICS]
    where = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column(where))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in found.T.copy())], names=[*keep, *STATISTICS])

    rows = docs.select(*keep)
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"{s} long" for s in STATISTICS]
    return rows.mapInArrow(tidy(run), ", ".join(schema))


def measures() -> dict[str, Column]:
    """Ratios of the statistics, by name; 0 where there is nothing to divide by.

    None of them grows or falls with a text's length alone, so rules learnt from short texts hold for long ones.
    """
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    letters = F.col("n_upper") + F.col("n_lower")
    return {
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "closed_lines": share("n_closed_lines", "n_lines"),
        "words_per_line": share("n_words", "n_lines"),
        "upper_letters": F.when(letters > 0, F.col("n_upper") / letters).otherwise(0.0),
        "digits": share("n_digits", "n_text_chars"),
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.threshold if self.above else x <= self.threshold

    def text(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold!r}"


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds decides, and a row that none covers is kept."""

    rules: tuple[Rule, ...] = ()

    def column(self) -> Column:
        """The number, from 1, of the first rule that holds over a table with ``STATISTICS``; 0 if none does."""
        have = measures()
        made = [F.expr("true") if not r else _all([have[c.measure] > c.threshold if c.above else have[c.measure] <= c.threshold for c in r]) for r in self.rules]
        if not made:
            return F.lit(0)
        out = F.when(made[0], 1)
        for i, x in enumerate(made[1:], 2):
            out = out.when(x, i)
        return out.otherwise(0)

    def text(self) -> str:
        """The rules as one readable CASE expression over measures."""
        lines = [f"WHEN {' AND '.join(c.text() for c in r) or 'TRUE'} THEN {i}" for i, r in enumerate(self.rules, 1)]
        return "\n".join(["CASE", *lines, "ELSE 0 END"]) if lines else "0"


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x[c.measure])
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold of greatest gain: rejected rows it keeps, times the bits by which their share rises."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    base = np.log2(p0 / (p0 + n0))
    best: tuple[float, Condition | None] = (0.0, None)
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v = values[order]
        cut = np.flatnonzero(v[1:] > v[:-1])  # between two different values
        if not len(cut):
            continue
        low = np.cumsum(bad[order])[cut]
        for above in (False, True):
            p = p0 - low if above else low
            k = len(v) - cut - 1 if above else cut + 1
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / k) - base), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), Condition(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 16, most_conditions: int = 4, least_share: float = 0.9, least_rows: int = 5, seed: int = 11) -> DecisionList:
    """Sequential covering of the ``bad`` rows.

    A rule stays if, pruned, at least ``least_share`` of the rows it covers are
    bad, on the rows it was grown from and on those it was pruned on, and if it
    covers ``least_rows`` bad ones.  Equal input gives equal rules.
    """
    rules: list[Rule] = []
    left = np.arange(len(bad))
    rng = np.random.default_rng(seed)
    while len(rules) < most_rules and bad[left].sum() >= least_rows:
        dealt = rng.permutation(len(left))
        grow, prune = left[dealt[len(left) // 3 :]], left[dealt[: len(left) // 3]]
        rule: Rule = ()
        inside = grow
        while len(rule) < most_conditions and bad[inside].any() and not bad[inside].all():
            _, condition = _best_condition({k: v[inside] for k, v in x.items()}, bad[inside])
            if condition is None:
                break
            rule += (condition,)
            inside = inside[condition.holds(x[condition.measure][inside])]
        # the shortest prefix that does best on rows it hasn't seen
        own = {k: v[prune] for k, v in x.items()}
        worth = []
        for k in range(1, len(rule) + 1):
            hit = _covers(rule[:k], own, len(prune))
            p, n = int(bad[prune][hit].sum()), int((~bad[prune])[hit].sum())
            worth.append((p - n) / (p + n) if p + n else -1.0)
        if not worth:
            break
        rule = rule[: int(np.argmax(worth)) + 1]
        hit = _covers(rule, {k: v[left] for k, v in x.items()}, len(left))
        seen = _covers(rule, own, len(prune))
        sure = lambda who: bad[who].sum() >= least_share * len(who)
        if bad[left[hit]].sum() < least_rows or not sure(left[hit]) or not sure(prune[seen]):
            break
        rules.append(rule)
        left = left[~hit]
    return DecisionList(tuple(rules))


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in three-word windows that the text repeats."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_rules(docs: DataFrame, doc: str, text: str, labels: DataFrame, label_doc: str, label: str, sample: int = SAMPLE, **how) -> DecisionList:
    """A list that rejects what ``label`` marks with 0, learnt from at most ``sample`` labelled documents that aren't held out.

    Texts that fail the base rule are left out, as it rejects them anyway.  A
    document whose labels differ counts as good; of rows that repeat an id each
    text is learnt from.  Null ids and labels are left out; without rows of
    both classes the list is empty, so everything is kept.
    """
    known = labels.filter(F.col(label_doc).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(label_doc).cast("long").alias("_doc")).agg(F.max(label).cast("int").alias("_label"))
    known = known.filter(~held_out("_doc")).orderBy(F.xxhash64("_doc"), "_doc").limit(sample)
    own = docs.select(F.col(doc).cast("long").alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(known), "_doc")
    rows = with_statistics(own, "_text").filter(~base_failed()).select("_doc", "_label", *[c.alias(k) for k, c in measures().items()]).toArrow()
    x = {k: rows[k].to_numpy() for k in measures()}
    order = np.lexsort((*x.values(), rows["_doc"].to_numpy()))
    return learn({k: v[order] for k, v in x.items()}, rows["_label"].to_numpy()[order] == 0, **how)


def judge(docs: DataFrame, text: str, rules: DecisionList) -> DataFrame:
    """``docs`` with ``STATISTICS``, ``base_failed``, ``rule`` (the first that holds, 0 if none) and ``kept``."""
    rows = with_statistics(docs.drop("base_failed", "rule", "kept"), text)
    rows = rows.withColumn("base_failed", base_failed()).withColumn("rule", rules.column())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))

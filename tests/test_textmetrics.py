"""Tokens, BLEU, ROUGE and segmentation against plain Python."""

import itertools
import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caravel.functions import textmetrics as M


def plain_bleu(p, r, smooth=False):
    if not p or not r:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        own, other = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, r))
        hit = sum((own & other).values())
        if not hit:
            if not smooth or n == 1:
                return 0.0
            hit = 0.1
        logs += math.log(hit / max(1, sum(own.values()))) / 4
    return math.exp(logs) * (1.0 if len(p) > len(r) else math.exp(1 - len(r) / len(p)))


def plain_rouge(p, r):
    row = [0] * (len(r) + 1)
    for x in p:
        last = 0
        for j, y in enumerate(r):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return 2 * row[-1] / (len(p) + len(r)) if row[-1] else 0.0


@pytest.fixture(scope="module")
def pairs():
    rnd = random.Random(1)
    made = [([rnd.choice("abcdefgh") for _ in range(rnd.choice([0, 1, 3, 5, 20, 150]))], [rnd.choice("abcdefgh") for _ in range(rnd.choice([0, 1, 3, 5, 20, 150]))]) for _ in range(200)]
    return made + [(list("abcde"), list("abcde")), ([], []), (list("abcd"), list("abcde")), (list("aaaa"), list("aa"))]


@pytest.mark.parametrize("smooth", [False, True])
def test_bleu(pairs, smooth):
    p, r = (pa.array(side, pa.list_(pa.string())) for side in zip(*pairs, strict=True))
    assert M.bleu4(p, r, smooth).tolist() == pytest.approx([plain_bleu(a, b, smooth) for a, b in pairs])
    assert M.bleu4(p.slice(3, 40), r.slice(3, 40), smooth).tolist() == pytest.approx([plain_bleu(a, b, smooth) for a, b in pairs[3:43]])


def test_rouge(pairs):
    p, r = (pa.array(side, pa.list_(pa.string())) for side in zip(*pairs, strict=True))
    assert M.rouge_l(p, r).tolist() == pytest.approx([plain_rouge(a, b) for a, b in pairs])
    assert M.rouge_l(p.slice(0, 0), r.slice(0, 0)).tolist() == []


def test_columns(spark):
    rows = spark.createDataFrame([("The cat sat on the mat", "the cat sat on a mat"), (None, "x"), ("心脏 MRI_2", "心 MRI_2")], "a string, b string")
    got = rows.select(M.tokens(F.col("a")).alias("t"), M.bleu_score(M.tokens(F.col("a")), M.tokens(F.col("b"))).alias("bleu"), M.smooth_bleu_score(M.tokens(F.col("a")), M.tokens(F.col("b"))).alias("smooth"), M.rouge_score(M.tokens(F.col("a")), M.tokens(F.col("b"))).alias("rouge")).collect()
    assert got[2].t == ["心", "脏", "mri_2"] and got[1].t == []
    assert [round(r.rouge, 6) for r in got] == [round(plain_rouge("the cat sat on the mat".split(), "the cat sat on a mat".split()), 6), 0.0, 0.8]
    assert got[0].bleu == pytest.approx(plain_bleu("the cat sat on the mat".split(), "the cat sat on a mat".split())) and got[2].bleu == 0.0 < got[2].smooth


def test_similarity(spark):
    import difflib

    rows = [("<think>a b</think>The Cat, sat.", "the cat sat"), (None, " !"), ("x", None), ("abcd efgh", "abxd fgh!"), ("心脏 病", "心 病")]
    got = spark.createDataFrame(rows, "a string, b string").select(M.bare_text(F.col("a")).alias("x"), M.bare_text(F.col("b")).alias("y")).select("x", "y", M.similarity("x", "y").alias("s")).collect()
    assert [r.s for r in got] == [1.0, 1.0, 0.0, difflib.SequenceMatcher(None, "abcdefgh", "abxdfgh").ratio(), 0.8] and got[0].x == "thecatsat"


def all_cuts(run, longest):
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        edge = [0, *[i + 1 for i, m in enumerate(marks) if m], len(run)]
        words = [run[a:b] for a, b in itertools.pairwise(edge)]
        if max(map(len, words)) <= longest:
            yield words


def test_segmentation(spark):
    rnd = random.Random(2)
    vocabulary = ["心", "脏", "心脏", "病", "心脏病", "病人", "人", "冠心病", "冠"]
    texts = ["".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 4))) + rnd.choice([" mri ", "。", "Ab1"]) for _ in range(300)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string")
    counted = M.counted_words(docs, "t", 3, 4)
    n = Counter(run[i : i + k] for t in texts for run in ["".join(c for c in t if "㐀" <= c <= "鿿")] for k in (1, 2, 3) for i in range(len(run) - k + 1))
    assert {r.word: r.n for r in counted.collect()} == {w: c for w, c in n.items() if c >= 4 or len(w) == 1}
    d = M.Dictionary.of(counted)
    log = dict(zip(d.words, d.logs, strict=True))
    runs = sorted({"".join(c for c in t if "㐀" <= c <= "鿿") for t in texts} | {"龙心脏", "龙"}, key=len)[:120]
    runs = [r for r in runs if len(r) <= 9]
    worth = lambda words: sum(log.get(w, d.unknown if len(w) == 1 else -math.inf) for w in words)
    for run, got in zip(runs, M.best_cuts(runs, d), strict=True):
        assert "".join(got) == run and worth(got) == pytest.approx(max(map(worth, all_cuts(run, 3))))
    cut = M.segmenter(d)
    rows = docs.select("t", cut(F.col("t")).alias("w")).collect()
    for r in rows:
        assert "".join(r.w) == "".join(c for c in (r.t or "").lower() if c not in " 。")
    assert any(len(w) > 1 and w > "㐀" for r in rows for w in r.w)
    assert M.best_cuts([], d) == [] and M.Dictionary.of(counted.limit(0)).words == ()

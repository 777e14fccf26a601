"""Quality rules, importance resampling and token alignment against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caravel.llm import align, quality, queries, resample, store

EXTRA = "doc_id long, text string, score double, n_words int, kept int, rank int, keys binary"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, 0.5, 3, 1, 2, b"x") for d, t in rows], EXTRA)


LONG = " ".join(f"w{i % 7_000}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "x" * 200_000), (6, "é ß ñ"), (7, "a\x00b\x1f c"), (7, "a\x00b\x1f c"), (None, "no id here")]

# quality rules


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = set()
    repeated = sum(x in seen or bool(seen.add(x)) for x in lines)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(inside))


TEXTS = ["A a a a a", "a b c a b c", "one\none\n one\n\n\none", "x y z\nx y z", "# * $ % & | < >", "Same line.\nsame line.\nSame line.\r\nSame line.", "a b\nc a b c a", "\n\n", "ü ü ü ü é é"]


def test_statistics(spark):
    rnd = random.Random(3)
    rows = ODD + [(100 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(200 + i, "".join(rnd.choice(["a", "b", "B", " ", " ", "\n", "#", "ö", "\t"]) for _ in range(rnd.randint(0, 90)))) for i in range(300)]
    got = quality.with_statistics(docs(spark, rows), "text")
    assert got.columns[:2] == ["doc_id", "text"] and got.columns.count("n_words") == 1
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(r.text), repr(r.text)[:80]
    assert quality.with_statistics(docs(spark, rows).limit(0), "text").count() == 0


def test_statistics_within_blocks():
    """Texts that share a block don't run into one another."""
    import pyarrow as pa

    column = pa.array(["a b", "c a b c", None, "c", "a b c"] * 3)
    one = quality.statistics(column)
    assert np.array_equal(one, np.concatenate([quality.statistics(pa.array([x], pa.string())) for x in column.to_pylist()]))


def test_learnt_rules_in_order():
    rng = np.random.default_rng(5)
    x = {"m": rng.random(2_000), "k": rng.random(2_000), "none": np.zeros(2_000)}
    bad = (x["m"] > 0.8) | ((x["k"] < 0.3) & (x["m"] < 0.4))
    rules = quality.learn(x, bad)
    assert 2 <= len(rules.rules) <= 16 and rules == quality.learn(x, bad)
    hit = np.zeros(2_000, bool)
    for r in rules.rules:
        hit |= quality._covers(r, x, 2_000)
    assert (hit == bad).mean() > 0.97
    assert rules.text().startswith("CASE\nWHEN ") and "THEN 2" in rules.text()


def test_noise_gives_no_rules():
    rng = np.random.default_rng(6)
    assert quality.learn({"m": rng.random(600)}, rng.random(600) < 0.1).rules == ()
    assert quality.learn({"m": np.zeros(0)}, np.zeros(0, bool)) == quality.DecisionList()


def test_judged_documents(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9))) for _ in range(rnd.randint(60, 90))]
        rows.append((i, " ".join(w + "###" if bad else w for w in words)))
        labels.append((i, int(not bad)))
    df = docs(spark, rows + ODD + [(900, "same words again " * 30)])
    known = spark.createDataFrame([*labels, (None, 0), (3, None), (1, 0)], "doc_id long, quality int")
    rules = quality.learn_rules(df, "doc_id", "text", known, "doc_id", "quality")
    assert len(rules.rules) == 1 and rules == quality.learn_rules(df.repartition(5), "doc_id", "text", known, "doc_id", "quality")
    got = quality.judge(df, "text", rules).collect()
    assert len(got) == len(rows) + len(ODD) + 1
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.rule == 0)
        if r.doc_id is not None and 7 < r.doc_id < 500:
            assert r.kept == (r.doc_id % 5 != 0)
    none = quality.learn_rules(df, "doc_id", "text", known.limit(0), "doc_id", "quality")
    assert none.rules == () and quality.judge(df, "text", none).filter("rule <> 0").count() == 0


def test_query_rules_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op11_decision_rules(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(t)
    labels = [(d, q) for d, q in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect() if zlib.crc32(str(d).encode()) % 3 == 1]
    judged = [(got[d].kept, q) for d, q in labels if not got[d].base_failed]
    assert sum(kept == bool(q) for kept, q in judged) / len(judged) > 0.97
    assert sum(not kept for kept, q in judged if q) <= 0.01 * len(judged)


# importance resampling


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features(text, longest):
    w = split(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_draw(rows, target, percent, least, buckets, longest):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(crc(f) for _, t in rows for f in features(t, longest))
    t = Counter(crc(f) for x in target for f in features(x, longest))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for d, x in rows:
        own = features(x, longest)
        weight = sum(gain(crc(f)) for f in own) // len(own) if own else 0
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
        out.append([d, len(own), weight, score, None, len(split(x))])
    able = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(["Alpha", "beta", "gamma,", "délta", "x1"]) + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 50)))) for i in range(n)]


@pytest.mark.parametrize(("percent", "longest", "size"), [(10, 1, 200_000), (37, 3, 7), (100, 2, 1), (0, 1, 5)])
def test_draws(spark, monkeypatch, percent, longest, size):
    monkeypatch.setattr(resample, "RANGE_ROWS", size)
    rows = ODD + corpus(1, 300) + corpus(2, 40)  # ids repeat with other texts, and a third of the rows is one row
    rows += [(11, rows[20][1] + " more words")] * 150 + [(12, "w " * 30)] * 5
    target = ["beta1 beta2 beta3 gamma4", None, "délta7 x11"]
    got = resample.resample(docs(spark, rows).repartition(6), "doc_id", "text", spark.createDataFrame([(t,) for t in target], "text string"), "text", percent, 20, 997, longest)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_draw(rows, target, percent, 20, 997, longest)


def test_draw_of_nothing(spark):
    target = spark.createDataFrame([("a",)], "text string")
    assert resample.resample(docs(spark, ODD).limit(0), "doc_id", "text", target, "text").count() == 0
    got = resample.resample(docs(spark, ODD), "doc_id", "text", target.limit(0), "text").collect()
    # one document has twenty words: a tenth of one is none
    assert len(got) == len(ODD) and all(r["rank"] is None for r in got)


def test_draw_from_one_score(spark, monkeypatch):
    """Far more rows of one score than a range holds are cut by their ids."""
    monkeypatch.setattr(resample, "RANGE_ROWS", 50)
    scored = store.settle(spark.range(1_000, numPartitions=5).selectExpr("id as doc_id", "30L as n_words", "30L as n_features", "5L as weight", "if(id < 900, 77L, 78L) as score"))
    got = {r.doc_id: r["rank"] for r in resample.draw(scored, 50, 20).collect()}
    order = [*range(900, 1_000), *range(900)]
    assert got == {d: (i + 1 if i < 500 else None) for i, d in enumerate(order)}


def test_runs_are_bounded_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(resample, "RANGE_ROWS", 20)
    seen = []
    kept = resample.sorted_runs
    monkeypatch.setattr(resample, "sorted_runs", lambda *a: seen.append(kept(*a)) or seen[-1])
    scored = store.settle(spark.range(2_000, numPartitions=4).selectExpr("id as doc_id", "30L as n_words", "1L as n_features", "id % 90 as weight", "id % 90 as score"))
    resample.draw(scored, 30, 20).count()
    sizes = [n for (n,) in seen[0].groupBy("range").agg(F.sum("rows")).select("sum(rows)").collect()]
    assert max(sizes) <= 45 and len(sizes) >= 15


def test_tournament(monkeypatch):
    rnd = random.Random(9)
    monkeypatch.setattr(resample, "FAN_IN", 4)
    for n in (0, 1, 2, 3, 5, 17):
        runs = [sorted([rnd.randint(0, 9), rnd.randint(0, 9)] for _ in range(rnd.randint(0, 8))) for _ in range(n)]
        assert list(resample.tournament(runs)) == sorted(x for r in runs for x in r)


def test_crcs():
    rnd = random.Random(8)
    words = ["", *["".join(rnd.choice("abé1") for _ in range(rnd.choice([1, 2, 5, 30, 47, 48, 49, 300]))) for _ in range(200)]]
    data = [w.encode() for w in words]
    end = np.cumsum([len(x) for x in data])
    got = resample.span_crcs(np.frombuffer(b"".join(data), np.uint8), end - [len(x) for x in data], end)
    assert got.tolist() == [zlib.crc32(x) for x in data]


# token alignment


def brute_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    linked, out = [], []
    for d, text in rows:
        a, b = ([], []) if not text else (one.encode(" " + text, add_special_tokens=False).ids, two.encode(text))
        bytes_a, bytes_b = [bytes(back[c] for c in one.id_to_token(i)) for i in a], [piece(two.id_to_piece(i)) for i in b]
        if text and not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            a, b, bytes_a, bytes_b = [], [], [], []
        ends = lambda parts: np.cumsum([len(x) for x in parts], dtype=int).tolist()
        end_a, end_b = ends(bytes_a), ends(bytes_b)
        both = sorted(set(end_a) & set(end_b))
        groups, begin = [], 0
        for e in both:
            inside = lambda ids, at, begin=begin, e=e: ",".join(str(i) for i, x in zip(ids, at, strict=True) if begin < x <= e)
            groups.append(f"{inside(a, end_a)}|{inside(b, end_b)}")
            begin = e
        links = []
        for x, e, p in zip(a, end_a, bytes_a, strict=True):
            links += [(x, y) for y, f, q in zip(b, end_b, bytes_b, strict=True) if e - len(p) < f and f - len(q) < e]
        linked.append(links)
        out.append([d, len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    n = Counter(p for links in linked for p in set(links))
    best = defaultdict(int)
    for (x, _), k in n.items():
        best[x] = max(best[x], k)
    return sorted((tuple(r) + (sum(n[p] == best[p[0]] for p in links), sum(n[p] for p in links)) for r, links in zip(out, linked, strict=True)), key=str)


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(align, "HELD_KEYS", 40)
    texts = [None, "", " ", "The cat sat.", "The cat sat.", " The  cat", "naïve façade 日本語 🙂", "tabs\tand\nlines \n\n", "<|endoftext|> <s> </s> <unk>", "a▁b", "zero\x00byte", "x" * 300, "aaa bbb " * 40, "Żółć i kość", "é vs é", "ﬁne №5 ①"]
    texts += [" ".join(random.Random(i).choice(["the", "cats", "unbelievable", "straße", "niño", "42"]) for _ in range(25)) for i in range(15)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "again"), (None, "The cat")]
    got = align.alignment(docs(spark, rows).repartition(3), "doc_id", "text")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_alignment(rows)
    assert align.alignment(docs(spark, rows).limit(0), "doc_id", "text").count() == 0


def test_alignment_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 1_500]
    got = align.alignment(spark.createDataFrame(short, "doc_id long, text string"), "doc_id", "text")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_alignment(short)
    whole = queries.op13_token_alignment(spark, sf).collect()
    assert len(whole) == len(rows) and all(r.n_links == r.n_a + r.n_b - r.n_groups and 0 < r.n_best <= r.n_links for r in whole)


def test_long_texts_align(spark):
    rows = [(1, LONG), (2, "y" * 50_000)]
    got = {r.doc_id: r for r in align.alignment(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert all(got[d].n_links == got[d].n_a + got[d].n_b - got[d].n_groups > 0 for d in (1, 2))


def test_groups_as_text(spark):
    row = align.document_links(spark.createDataFrame([(1, "The cat")], "doc_id long, text string"), "doc_id", "text", groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.groups.count(";") == row.n_groups - 1
    assert len(align.unpack(row["keys"])) == len(np.frombuffer(row["times"], "<u4"))


def test_packed_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**47, 500))
    assert np.array_equal(align.unpack(align.pack(keys)), keys)
    assert len(align.unpack(align.pack(keys[:0]))) == 0

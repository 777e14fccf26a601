import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caravel.llm import decontaminate, packing, queries, tokens, topk, toxicity, unitdedup, wordpiece

EXTRA = "doc_id long, text string, score double, n_words int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, 0.5, 3) for d, t in rows], EXTRA)


# toxicity


def toxic_corpus(seed=1, n=900):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        bad = rnd.random() < 0.2
        if bad:
            for _ in range(2):
                w.insert(rnd.randrange(len(w)), rnd.choice(["Vile", "nasty", "awful"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    df = docs(spark, [*rows, (5000, None), (5001, ""), (None, "vile nasty"), (5002, "w1 " * 200_000)])
    model = toxicity.train(df, "doc_id", "text", known, "doc_id", "toxic")
    got = toxicity.score(df, "text", model).withColumn("held", toxicity.held_out("doc_id")).collect()
    assert len(got) == len(rows) + 4 and got[0].asDict().keys() == {"doc_id", "text", "score", "n_words", "held"}
    truth = dict(labels)
    held = [r for r in got if r.held and r.doc_id in truth]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.score < 0.5 for r in got if r.doc_id in (5000, 5001)} == {5000: True, 5001: True}
    again = toxicity.train(df.repartition(7), "doc_id", "text", known, "doc_id", "toxic")
    assert np.array_equal(model[0], again[0])


def test_toxicity_without_labels(spark):
    df = docs(spark, [(1, "a b")])
    model = toxicity.train(df, "doc_id", "text", spark.createDataFrame([], "doc_id long, toxic int"), "doc_id", "toxic")
    assert toxicity.score(df, "text", model).first().score == 0.5
    assert toxicity.score(df.limit(0), "text", model).count() == 0


def test_toxicity_learns_from_whole_texts_within_its_bytes(spark, monkeypatch):
    rows, labels = toxic_corpus(n=300)
    long = " ".join(f"u{i}" for i in range(20_000))
    known = spark.createDataFrame([*labels, (900, 1)], "doc_id long, toxic int")
    df = docs(spark, [*rows, (900, long + " vile")])
    whole = toxicity.train(df, "doc_id", "text", known, "doc_id", "toxic")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 40_000)
    some = toxicity.train(df, "doc_id", "text", known, "doc_id", "toxic")
    assert np.array_equal(some[0], toxicity.train(df.repartition(5), "doc_id", "text", known, "doc_id", "toxic")[0])
    assert not np.array_equal(whole[0], some[0]) and np.count_nonzero(some[0]) < np.count_nonzero(whole[0])
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 0)
    assert toxicity.train(df, "doc_id", "text", known, "doc_id", "toxic")[0].shape == whole[0].shape


# decontamination


def brute_hits(rows, items, size):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = set()
    for i, t in items:
        w = split(t)
        if i is not None and w:
            windows |= {(tuple(w[j : j + size]), str(i)) for j in range(max(1, len(w) - size + 1))}
    out = []
    for d, t in rows:
        w = split(t)
        hit, found = set(), set()
        for x, i in windows:
            for j in range(len(w) - len(x) + 1):
                if tuple(w[j : j + len(x)]) == x:
                    hit |= set(range(j, j + len(x)))
                    found.add(i)
        out.append((d or -1, len(w), len(hit), sorted(found)))
    return sorted(out)


def test_decontamination(spark):
    rnd = random.Random(4)
    words = [f"v{i}" for i in range(60)] + ["the", "of"] * 20
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(rnd.randint(12, 30))) for i in range(20)] + [(20, "short item here"), (21, ""), (22, None), (None, text(20)), (3, "the of the of the of the of the of the")]
    items += [items[0]]
    rows = [(i, text(rnd.randint(0, 80))) for i in range(60)]
    rows += [(100 + i, text(20) + "; " + (t or "").upper() + "--" + text(5)) for i, t in items if i is not None]
    rows += [(300, None), (301, ""), (302, "the of " * 3000), (303, "A short item here."), (303, "other"), (None, items[0][1])]
    got = decontaminate.decontaminate(docs(spark, rows), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 10)
    assert sorted(set(got.columns)) == sorted({"doc_id", "text", "score", "n_words", "n_hit", "items", "contaminated"})
    found = got.collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in found) == brute_hits(rows, items, 10)
    assert all(r.contaminated == (r.n_hit > 0) for r in found)
    none = decontaminate.decontaminate(docs(spark, rows), "doc_id", "text", spark.createDataFrame([], "item_id long, text string"), "item_id", "text", 10)
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows)


@pytest.mark.parametrize("most", [0, 5_000, 64 << 20])
def test_passage_of_very_many_items(spark, monkeypatch, most):
    """A window's items don't travel with its places, and tables too large to be broadcast are shuffled."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    passage = " ".join(f"p{i}" for i in range(11))
    items = [(i, passage) for i in range(400)] + [(900, passage + " tail"), (901, "some other words of one item that is long enough")]
    rows = [(i, f"before {passage} behind") for i in range(30)] + [(77, "some Other words of one item that is long enough"), (78, "p0 p1 p2"), (None, passage)]
    got = decontaminate.decontaminate(docs(spark, rows), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 10)
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == brute_hits(rows, items, 10)


# packing


@pytest.fixture(scope="module")
def tokenised():
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["the", "straße", "naïve", "x9", "<|endoftext|>", "\n\n", "😀"]) for _ in range(rnd.choice([0, 1, 5, 30, 200])))) for i in range(80)]
    return [*rows, (500, None), (501, ""), (502, "a b c " * 3000), (7, rows[7][1])]


def true_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.place(tokens.TOKENIZER)).encode(text or "", add_special_tokens=False).ids + [0]


def test_encode_equals_tokenizer(tokenised):
    names = tokens.place(tokens.TOKENIZER), tokens.place(tokens.RANKS)
    for _, t in [*tokenised, (0, "x" * 2000), (0, " \t " * 500), (0, "it's we'll ١٢ ½  　 zz")]:
        assert tokens.encode(t or "", *names).tolist() + [0] == true_ids(t)


def test_pattern_packing(spark, tokenised):
    size = 128
    made = packing.pattern_pack(packing.pieces(docs(spark, tokenised), "doc_id", "text", size), size).collect()
    want = []
    for d, t in tokenised:
        ids = np.array(true_ids(t), "<u4")
        first = len(ids) - size * (-(-len(ids) // size) - 1)
        at, length = 0, first
        i = 0
        while at < len(ids):
            want.append((d, i, at, length, zlib.crc32(ids[at : at + length].tobytes())))
            at, length, i = at + length, size, i + 1
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made) == sorted(want)
    by = {}
    for r in made:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in made)
    assert len(by) <= -(-total // size) + 2
    assert packing.pattern_pack(packing.pieces(docs(spark, []), "doc_id", "text", size), size).count() == 0


def test_packing_of_null_ids(spark):
    """Rows without an id are packed like others, also in several pieces."""
    rows = [(None, "a b c " * 200), (None, "x"), (None, "x"), (1, "y")]
    made = packing.pattern_pack(packing.pieces(docs(spark, rows), "doc_id", "text", 128), 128).collect()
    assert sum(r.length for r in made) == sum(len(true_ids(t)) for _, t in rows)
    places = {}
    for r in made:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 128


def test_plans_use_patterns():
    rnd = np.random.default_rng(8)
    h = np.bincount(np.clip(rnd.lognormal(5, 1, 40_000).astype(int), 1, 512), minlength=513)
    kinds = packing.plan(h, 512)
    used = np.zeros(513, int)
    for lengths, n in kinds:
        assert sum(lengths) <= 512
        for v in lengths:
            used[v] += n
    assert (used == h).all()
    assert sum(n for _, n in kinds) <= 1.01 * (np.arange(513) @ h) / 512


def test_best_fit_pack(spark, tokenised, tmp_path):
    size = 128
    rows = [*tokenised, (None, "no id")]
    packing.write_packed(packing.best_fit_pack(docs(spark, rows), "doc_id", "text", size, block=50), f"{tmp_path}/packed")
    assert all(len(r.input_ids) == len(r.position_ids) == 4 * size for r in spark.read.parquet(f"{tmp_path}/packed").collect())
    made = packing.read_packed(spark, f"{tmp_path}/packed").collect()
    parts = {}
    for r in made:
        assert len(r.input_ids) == len(r.position_ids) == r.cu_seqlens[-1] <= size
        for d, p, s, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert r.position_ids[a:b] == list(range(b - a))
            parts.setdefault((d, s), []).append(r.input_ids[a:b])
    for d, t in rows:
        ids = true_ids(t)
        joined = [x for (dd, s) in sorted(k for k in parts if k[0] == d) for x in parts[dd, s][0]]
        assert joined == ids
    assert len({r.sequence_id for r in made}) == len(made)
    assert packing.best_fit_pack(docs(spark, []), "doc_id", "text", size).count() == 0


def test_best_fit_decreasing_is_best_fit():
    rnd = random.Random(9)
    for _ in range(50):
        lengths = [rnd.randint(1, 30) for _ in range(rnd.randint(0, 60))]
        got = packing.best_fit_decreasing(lengths, 32)
        free = []
        for v in sorted(lengths, reverse=True):
            able = [i for i, x in enumerate(free) if x >= v]
            if able:
                free[min(able, key=lambda i: free[i])] -= v
            else:
                free.append(32 - v)
        assert sorted(i for x in got for i in x) == list(range(len(lengths)))
        assert sorted(32 - sum(lengths[i] for i in x) for x in got) == sorted(free)


# token counts


def greedy(word, first, inner):
    n, at = 0, 0
    while at < len(word):
        pool = inner if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_word_pieces_small():
    rnd = random.Random(10)
    for _ in range(200):
        piece = lambda: bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 4)))
        first, inner = {piece() for _ in range(8)}, {piece() for _ in range(8)}
        machine = wordpiece.Automaton(first, inner)
        words = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(1, 12))) for _ in range(60)] + [b"a" * 200, b"abc" * 50]
        text = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words])
        got = machine.counts(text, end - [len(w) for w in words], end)
        assert got.tolist() == [greedy(w, first, inner) for w in words]


def test_piece_counts(spark):
    rows = [(1, "The quick  brown\tfox straße 😀"), (2, None), (3, ""), (4, "a" * 5000 + " b"), (4, "x")]
    first, inner = (set(x) for x in wordpiece.vocabulary())
    for r in wordpiece.piece_counts(docs(spark, rows), "text").collect():
        n = [greedy(w.encode(), first, inner) for w in (r.text or "").split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(n), sum(max(x, 1) for x in n), n.count(0))
    assert wordpiece.piece_counts(docs(spark, []), "text").count() == 0


# top k


@pytest.mark.parametrize("copies", [0, 900])
def test_top_k(spark, copies):
    rnd = np.random.default_rng(11)
    centre = rnd.normal(size=(5, 16))
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i in range(700) if (v := centre[i % 5] + 0.3 * rnd.normal(size=16)) is not None]
    rows += [(1000 + i, rows[0][1]) for i in range(copies)]
    odd = [(2000, None), (2001, [float("nan")] + [0.0] * 15), (2002, [None] + [0.0] * 15), (2003, [float("inf")] + [0.0] * 15), (None, rows[0][1]), (20, rows[20][1]), (2020, [1.0, 2.0]), (2021, [1.0, -2.0])]
    df = spark.createDataFrame([*((i, v, 1) for i, v in [*rows, *odd])], "vec_id long, embedding array<float>, rank int")
    got = topk.top_k(df, "vec_id", "embedding", 20, 20).collect()
    whole = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in [*rows, odd[6], odd[7]]}
    want = []
    for q, v in whole.items():
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in whole.items() if i != q and len(w) == len(v))[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), "vec_id", "embedding", 20, 20).count() == 0


# unit dedup



@pytest.mark.parametrize("kind", ["line", "sentence", "paragraph"])
def test_units(spark, kind):
    rnd = random.Random(12)
    pool = [" ".join(rnd.choice(["The", "cat", "saß", "on", "a", "mat", "ö"]) for _ in range(rnd.randint(2, 12))) for _ in range(40)]
    ends = {"line": "\n", "paragraph": "\n\n", "sentence": ". "}[kind]
    rows = [(i, ends.join(rnd.choice(pool).upper() if rnd.random() < 0.2 else rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n. "), (None, rows[0][1])]
    found = unitdedup.repeated_units(docs(spark, rows), "doc_id", "text", kind, 4)
    got = found.select("doc", "start", "end", "words", "kept_doc", "kept_start").collect()
    seen, want = {}, []
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        at = 0
        parts = (t or "").split(ends)
        for i, part in enumerate(parts):
            # a sentence's unit holds its mark
            whole = part + ("." if kind == "sentence" and i < len(parts) - 1 else "")
            key = tuple(lower(whole).split())
            if len(key) >= 4:
                place = (d, at, at + len(whole), len(key))
                if key in seen:
                    want.append((*place, *seen[key]))
                else:
                    seen[key] = place[:2]
            at += len(part) + len(ends)
    assert sorted(tuple(r) for r in got) == sorted(want)
    removed = unitdedup.repeated_units(docs(spark, rows), "doc_id", "text", kind, 4)
    cut = {r.doc_id: r.text for r in unitdedup.without_units(docs(spark, rows), "doc_id", "text", removed).collect()}
    for d, t in rows:
        if d is not None:
            spans = [(r.start, r.end) for r in got if r.doc == d]
            left = t
            for a, b in sorted(spans, reverse=True):
                left = left[:a] + left[b:]
            assert cut[d] == left
    assert len(cut) == len(rows)


def spans(text, mark, least):
    """(start, end) of the parts between ``mark`` (a pattern), from first to last word, with ``least`` words or more."""
    at, out = 0, set()
    for x in [*re.finditer(mark, text), None]:
        part = text[at : x.end() if x else len(text)]
        if len(part.split()) >= least:
            out.add((at + len(part) - len(part.lstrip()), at + len(part.rstrip())))
        at = x.end() if x else at
    return out


def test_unit_query(spark, tmp_path, monkeypatch):
    """Paragraphs, lines and sentences of enough words repeat; what a larger repeat holds isn't given again."""
    rnd = random.Random(31)
    phrase = lambda lo, hi: " ".join(rnd.choice(["the", "cat", "saß", "on", "Ein", "mat", "zu"]) for _ in range(rnd.randint(lo, hi)))
    sentences = [phrase(1, 12) + rnd.choice([".", "!", ""]) for _ in range(40)]
    lines = [" ".join(rnd.choice(sentences) for _ in range(rnd.randint(1, 4))) for _ in range(30)]
    paragraphs = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 3))) for _ in range(25)]
    rows = [(i, "\n\n".join(rnd.choice(paragraphs) if rnd.random() < 0.5 else rnd.choice(lines) for _ in range(rnd.randint(0, 4)))) for i in range(30)]
    short = "One two. Three four. Five six. Seven."
    rows += [(100, None), (101, ""), (102, short), (103, f"new line here\n{short}"), (104, "许可证。"), (105, "许可证。\nmore"), (106, "five words in a line"), (107, "Five words in a  line\nx")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "UNITS", {"paragraph": 6, "line": 4, "sentence": 8})
    got = queries.op9_unit_dedup(spark, str(tmp_path)).collect()
    first, found = {}, []
    for d, t in rows:
        t = t or ""
        for a, b in sorted(spans(t, r"\n\n", 6) | spans(t, r"\n", 4) | spans(t, r"[.!?](?=\s|$)|\n", 8)):
            key = tuple(re.sub("[A-Z]", lambda m: m[0].lower(), t[a:b]).split())
            if first.setdefault(key, (d, a)) != (d, a):
                found.append((d, a, b, len(key), *first[key]))
    want = [x for x in found if not any(y[0] == x[0] and y[1] <= x[1] and x[2] <= y[2] and y[1:3] != x[1:3] for y in found)]
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    assert {(103, 14, 14 + len(short), 7, 102, 0), (107, 0, 21, 5, 106, 0)} <= set(want)
    assert len({x[3] >= 8 for x in want}) == 2
    for r in got:
        left = dict(rows)[r.doc_id]
        for x in sorted((x for x in want if x[0] == r.doc_id), reverse=True):
            left = left[: x[1]] + left[x[2] :]
        assert r.left_sha256 == hashlib.sha256(left.encode()).hexdigest()


@pytest.mark.parametrize(("dims", "far"), [(4100, 3), (5000, 2**20), (3, 2**27)])
def test_top_k_of_wide_and_large_vectors(dims, far):
    """Sums that pass 53 bits are taken in whole numbers."""
    rnd = np.random.default_rng(dims)
    rows = rnd.integers(-far, far, (90, dims))
    index = topk.ImpactIndex(np.arange(90), rows)
    for q in range(0, 90, 30):
        scores = rows.astype(object) @ rows[q].astype(object)
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        ids, got, scored = index.top(rows[q], q, 5)
        assert [(-s, i) for s, i in zip(got.tolist(), ids.tolist(), strict=True)] == want and 5 <= scored < 90
    with pytest.raises(ValueError, match="63 bits"):
        topk.ImpactIndex(np.arange(2), np.full((2, 9), 2**40)).top(np.full(9, 2**30), 0, 1)


def test_top_k_excludes_by_proof():
    """Of vectors on a sphere few are scored exactly."""
    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(3000, 32))
    rows = np.floor(64 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    index = topk.ImpactIndex(np.arange(3000), rows)
    assert sum(index.top(rows[i], i, 20)[2] for i in range(20)) < 0.2 * 20 * 3000


def test_ftrl_against_plain_python():
    """The weights are those of the textbook steps, coordinate by coordinate."""
    rnd = random.Random(3)
    rows = [np.array(sorted(rnd.sample(range(40), rnd.randint(0, 8))), np.int32) for _ in range(120)]
    labels = np.array([float(bool({1, 2} & set(r.tolist()))) for r in rows])
    alpha, beta, l1, l2 = 0.7, 1.0, 0.5, 0.3
    w, bias = toxicity.ftrl(rows, labels, alpha, beta, l1, l2, 3, 5)
    z, n, b = {}, {}, [0.0, 0.0]

    def weight(i):
        own = z.get(i, 0.0)
        return 0.0 if abs(own) <= l1 else ((l1 if own > 0 else -l1) - own) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    def shift():
        return -b[0] / ((beta + b[1] ** 0.5) / alpha)

    order = np.random.default_rng(5)
    for _ in range(3):
        for at in order.permutation(len(rows)):
            p = 1 / (1 + np.exp(-(sum(weight(i) for i in rows[at].tolist()) + shift())))
            g = p - labels[at]
            for i in rows[at].tolist():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * weight(i)
                n[i] = old + g * g
            b[0] += g - ((b[1] + g * g) ** 0.5 - b[1] ** 0.5) / alpha * shift()
            b[1] += g * g
    assert np.allclose(w[:40], [weight(i) for i in range(40)], atol=1e-5) and not w[40:].any() and abs(bias - shift()) < 1e-9
    assert (w[:40] == 0).any() and (w[:40] != 0).any()


def test_toxicity_scores_against_plain_python(spark):
    """A score is the logistic of the weights of the distinct features, one by one; rows that repeat and differ in labels count as toxic."""
    rows, labels = toxic_corpus(4, 300)
    df = docs(spark, [*rows, rows[0], (7, "another text")])
    known = spark.createDataFrame([*labels, (7, 1), (7, 0)], "doc_id long, toxic int")
    weights, bias = toxicity.train(df, "doc_id", "text", known, "doc_id", "toxic")

    def hashed(word):
        w = np.frombuffer(word, np.uint8)
        return toxicity.word_hashes(w, np.array([0]), np.array([len(w)]))[0]

    def one(text):
        words = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        h = [hashed(x) for x in words]
        found = set(h)
        with np.errstate(over="ignore"):
            for gap, salt in ((1, 0x632BE59BD9B4E019), (2, 0x9E6C63D0876A9A35)):
                found |= {toxicity.mix(np.array([a * np.uint64(salt) + b]))[0] for a, b in zip(h, h[gap:], strict=False)}
            for size in toxicity.STEMS:
                found |= {toxicity.mix(np.array([hashed(x[:size]) + np.uint64(size)]))[0] for x in words if len(x) > size}
        cells = {int(f) & ((1 << toxicity.BITS) - 1) for f in found}
        return 1 / (1 + np.exp(-(sum(float(weights[c]) for c in cells) + bias)))

    for r in toxicity.score(df, "text", (weights, bias)).collect()[::7]:
        assert abs(r.score - one(r.text)) < 1e-6

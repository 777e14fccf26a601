"""The pipeline, stage by stage, against plain Python on small tables; the queries against their SQL."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caravel.llm import queries, toxicity
from tests.llm import brute
from tests.llm.test_others import brute_hits, true_ids

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(150)] + ["the", "of", "and"] * 8
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(15)) for i in range(5)]
    rows, labels = [], []
    for i in range(240):
        lines = [text(rnd.randint(1, 25)) for _ in range(rnd.randint(0, 5))]
        if rows and rnd.random() < 0.2:
            lines = rnd.choice(rows)[1].split("\n")
            if rnd.random() < 0.5 and lines[0]:
                lines = [*lines[:-1], lines[-1] + " extra"]
        if rnd.random() < 0.1:
            lines.append("see " + rnd.choice(items)[1] + " end")
        bad = rnd.random() < 0.25
        if bad:
            lines += ["vile and nasty", "awful vile"]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "short")]
    folder = str(tmp_path_factory.mktemp("small"))
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, small, tmp_path):
    folder, items = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], folder).write.parquet(f"{tmp_path}/{i}")
        frames.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(f.columns == docs.columns for f in frames[:-1])
    before = [texts(f) for f in frames[:-1]]

    model = toxicity.train(docs, "doc_id", "text", spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "toxic")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, "text", model).collect()}
    assert sorted(d for d, _ in before[1]) == sorted(d for d, s in scores.items() if s < 0.7)
    assert 20 < sum(s >= 0.7 for s in scores.values()) < 100

    gone = brute.removed(before[1], 5, 80, 100)
    want = {}
    for d, t in before[1]:
        lines = None if t is None else [x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, [])]
        if d not in gone or any(brute.words(x) for x in lines):
            want[d] = None if t is None else "\n".join(lines)
    assert dict(before[2]) == want and len(before[2]) == len(want)
    assert all(r.text is None or r.n_chars == len(r.text) for r in frames[2].collect())

    linked = brute.components(before[2], 5, 80, 100)
    assert sorted(d for d, _ in before[3]) == sorted(d for d, (_, c) in linked.items() if c == d)

    hits = {d: n for d, _, n, _ in brute_hits(before[3], items, 10)}
    assert sorted(d for d, _ in before[4]) == sorted(d for d, n in hits.items() if not n)
    assert any(hits.values())

    packed = frames[5].collect()
    assert sorted((r.doc_id, r.length) for r in packed) == sorted((d, len(true_ids(t))) for d, t in before[4])
    room = {}
    for r in packed:
        room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
    assert max(room.values()) <= 2048

    again = corpus_pipeline.run(spark, folder)
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, again.collect())) == sorted(map(key, packed))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], SCHEMA)


def test_documents_that_say_something_new_stay(spark):
    """A document that lost lines goes only if nothing is left."""
    notice = "this notice has five words"
    rows = [(0, f"{notice}\nalpha"), (1, f"{notice}\nmilk\neggs"), (2, f"{notice}\nMilk\n\teggs "), (3, f"许可证。\n{notice}"), (4, notice), (5, f"{notice}\n\n \t"), (6, "milk"), (7, None), (8, f"{notice}\neggs\na b c d"), (9, f"{notice}\neggs\na b c d e"), (10, " \n"), (11, ""), (None, f"{notice}\nnew")]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, table(spark, rows), "").collect()}
    assert got == {0: f"{notice}\nalpha", 1: "milk\neggs", 3: "许可证。", 7: None, 8: "a b c d", 9: "a b c d e", 10: " \n", 11: "", None: f"{notice}\nnew"}


def test_one_row_of_a_group_stays(spark):
    """Rows are judged by their own texts, also where ids repeat; of repeated rows one stays."""
    a, b, c = "a b c d e f g", "p q r s t u v", "one two three four five"
    rows = [(3, a), (3, a), (5, a), (5, b), (8, c), (8, c), (9, None), (9, None), (None, a), (10, "")]
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.keep_one_of_group(spark, table(spark, rows), "").collect())
    assert got == [(0, a), (3, a), (5, b), (8, c), (9, ""), (9, ""), (10, "")]


def test_clashing_columns_pass_the_join(spark):
    rows = [(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 4, 5, 6), (3, "other words stay", 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc int, _r int, first int")
    out = corpus_pipeline.keep_one_of_group(spark, df, "")
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


def test_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, fields in (("documents", schema), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], fields).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = queries.QUERIES[name](spark, DIR)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
def test_all_operators_give_rows(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)):
        assert queries.QUERIES[name](spark, DIR).agg(F.count("*")).first()[0] > 0

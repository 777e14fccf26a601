"""Quoted CSV in many blocks, streams of samples and chunks, keyed ingest, keywords and indexes."""

import csv
import glob
import io
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from caravel.functions import report
from caravel.operators import index, keywords, vectors
from caravel.plans import corpora
from caravel.sources import qa, quoted, samples
from caravel.streaming import reports
from caravel.streaming.ingest import ingest, stored_keys


@pytest.fixture
def small_blocks(spark):
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    spark.conf.set(name, "3000")
    yield
    spark.conf.set(name, old)


def test_records_over_many_blocks(spark, tmp_path, small_blocks):
    rnd = random.Random(5)
    cell = lambda: "".join(rnd.choice(['"', "\n", ",", "é", "a", " b", "\r\n", "日"]) for _ in range(rnd.choice([0, 1, 3, 20, 400])))
    rows = [[f"r{i}", cell(), cell() + "."] for i in range(900)] + [["long", "x\n\n\"y\"\n" * 3_000, "end"]] + [[f"s{i}", cell(), "."] for i in range(300)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\n").writerows([["image_path", "caption", "vqa_json"], *rows])
    text = out.getvalue().replace("\nr500,", "\n\n\r\nr500,")  # blank lines between records
    (tmp_path / "big.csv").write_bytes("﻿".encode() + text.encode())
    assert spark.read.text(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 20
    found = {r.record: r.text for r in quoted.records(spark, str(tmp_path / "big.csv")).collect()}
    assert sorted(found) == list(range(len(rows) + 1))
    assert [next(csv.reader(io.StringIO(found[i + 1], newline=""))) for i in range(len(rows))] == rows
    read = qa.read_image_rows(spark, str(tmp_path / "big.csv"), "train").collect()
    got = {r.row_index: (r.image_path, r.caption, r.vqa_json) for r in read}
    assert len(read) == len(rows) and all(got[i] == tuple(r) for i, r in enumerate(rows) if not any("\r" in c for c in r))


def test_several_files_of_records(spark, tmp_path, small_blocks):
    for name, n in (("a", 400), ("b", 3)):
        (tmp_path / f"{name}.csv").write_text("h\r\n" + "".join(f'"{name}\n{i}"\r\n' for i in range(n)), newline="")
    got = {(r.path[-5:], r.record): r.text for r in quoted.records(spark, str(tmp_path)).collect()}
    assert got == {(f"{n}.csv", i): ("h" if i == 0 else f'"{n}\n{i - 1}"') for n, m in (("a", 400), ("b", 3)) for i in range(m + 1)}


def test_wrong_numbers_of_fields_raise(spark, tmp_path):
    (tmp_path / "x.csv").write_text("image_path,vqa_json\na,b\nc\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        qa.read_image_rows(spark, str(tmp_path / "x.csv"), "train").collect()
    (tmp_path / "y.csv").write_text("")
    with pytest.raises(ValueError, match="no column image_path, vqa_json"):
        qa.read_image_rows(spark, str(tmp_path / "y.csv"), "train")


def test_sample_stream_stops_within_a_row(spark, tmp_path):
    rows = [(f"{r}:{c}:{i}", r, c, o, i) for r in range(9) for o, c in enumerate(("open_ended", "closed_ended")) for i in range(r % 3 + 1)]
    df = spark.createDataFrame(rows, "id string, row_index long, category string, ord int, qa_index int").repartition(3)
    path, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    samples.store_samples(df, path)
    samples.register(spark)
    whole = spark.read.format("qa_samples").option("path", path).option("samplesPerTask", 4).load()
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[3], r[4]))]
    assert len(samples.SampleReader({"path": path, "samplesPerTask": "4"}).partitions()) == -(-len(rows) // 4)
    assert [r.id for r in whole.orderBy("place").collect()] == want
    assert samples.split_at(whole, 5).count() == len(rows) - 5

    def once():
        stream = spark.readStream.format("qa_samples").option("path", path).option("samplesPerBatch", 13).option("progress", f"{progress}/place/at").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(once=True).start().awaitTermination()
        return [r.id for r in spark.read.parquet(out).orderBy("place").collect()]

    for n in (13, 26, 39):
        assert once() == want[:n]
    assert want[12].split(":")[0] == want[13].split(":")[0]  # a batch ended within a row
    with pytest.raises(ValueError, match="needs the option progress"):
        samples.SampleStreamReader({"path": path, "samplesPerBatch": "5"})


def test_a_stretch_opens_only_its_own_row_groups(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.range(200_000).selectExpr("concat('a sample of the number ', id) AS id", "id DIV 4 AS row_index", "'open_ended' AS category", "0 AS ord", "id % 4 AS qa_index")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        samples.store_samples(df, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = glob.glob(f"{path}/*.parquet")
    assert len(files) > 1 and all(pq.ParquetFile(f).metadata.num_row_groups > 1 for f in files)
    reader = samples.SampleReader({"path": path, "samplesPerTask": "1000"})
    stretches = reader.partitions()
    got = [p for s in stretches for b in reader.read(s) for p in b.column("place").to_pylist()]
    assert got == list(range(200_000))
    assert reader.offset(123_456) == {"place": 123_456, "row": 123_455 // 4, "category": "open_ended", "index": 123_455 % 4}
    assert len(samples.SampleReader({"path": path, "samplesPerTask": "10"}).partitions()) == 1000
    mine = min(files, key=lambda f: pq.read_table(f, columns=["place"])["place"][0].as_py())
    for f in files:
        if f != mine:
            with open(f, "wb") as out:
                out.write(b"not to be opened")
    assert sum(b.num_rows for b in reader.read(stretches[3])) == 1000


STREAM = 'data: {"diagnosis": "é日", "findings": "f"}\n\n: note {"advice": "a"}\ndata: {"delta": {"diagnosis": "last"}}\r\ndata: [DONE]\ndata: {"findings": " "}'


def chunked(request, text, sizes, rnd):
    data, out = text.encode(), []
    while data:
        n = rnd.choice(sizes)
        out.append((request, len(out), data[:n], not data[n:]))
        data = data[n:]
    return out


def test_chunks_cut_anywhere_give_the_whole_report(spark, tmp_path):
    rnd = random.Random(3)
    streams = {f"r{i}": STREAM.replace("last", f"last{i}") for i in range(12)}
    rows = [c for k, t in streams.items() for c in chunked(k, t, [1, 2, 3, 7, 40], rnd)]
    rows += rnd.sample(rows, 20)  # some come twice
    rows += [("r0", 10_000, b"behind the end\n", False)]
    rnd.shuffle(rows)
    folder = str(tmp_path / "in")
    schema = "request string, seq long, chunk binary, last boolean"
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(folder)
    lines = reports.stream_lines(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    text = {}
    for r in sorted(found.collect(), key=lambda r: r.line):
        text.setdefault(r.request, []).append(r.text)
    assert {k: "\n".join(v) for k, v in text.items()} == streams
    once = spark.createDataFrame(list(streams.items()), "request string, t string").select("request", report.folded(report.events_of(F.col("t"))).alias("report"))
    assert {r.request: r.report for r in reports.folded_reports(found).collect()} == {r.request: r.report for r in once.collect()}


def test_a_silent_request_is_given_up(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "request string, seq long, chunk binary, last boolean"
    rows = [("a", 0, b"x\ny", False), ("a", 3, b"w\nv", False), ("a", 2, b"z", False), ("a", None, b"no", False), ("b", 0, None, None), ("b", 1, b"only", True)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    lines = reports.stream_lines(spark.readStream.schema(schema).parquet(folder), "1 second")
    writer = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    running = writer.trigger(processingTime="500 milliseconds").start()
    want = {("a", 0, "x", False), ("a", 1, "yzw", True), ("a", 2, "v", True), ("b", 0, "only", False)}
    for _ in range(60):
        if (found := {tuple(r) for r in spark.read.schema("request string, line long, text string, after_gap boolean").parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out").exists() else set()) == want:
            break
        time.sleep(1)
    running.stop()
    assert found == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_report_batches_do_not_grow_with_partitions(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{root}/reports-*"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        corpora.streamed_reports(spark, "/root/testdata/sf0.001")
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    (made,) = set(glob.glob(f"{root}/reports-*")) - before
    assert 0 < len(glob.glob(f"{made}/chunks/*.parquet")) <= 2 * 2 * spark.sparkContext.defaultParallelism


def test_a_fold_parses_a_payload_once(spark):
    df = spark.createDataFrame([(["{", '{"data": {"diagnosis": "d", "findings": " "}}', '{"findings": "f"}', '{"diagnosis": ""}'],), ([],), (None,)], "p array<string>")
    out = df.select(report.folded(F.col("p")).alias("r")).select("r.diagnosis", "r.findings")
    assert [tuple(r) for r in out.collect()] == [("d", "f"), ("", ""), ("", "")]
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert len(re.findall(r"parse_?json", plan)) == 1


def test_ingest_reads_only_its_buckets(spark, tmp_path):
    target = str(tmp_path / "out")
    schema = "k long, v long"

    def run(i, first, last):
        spark.range(first, last).selectExpr("id AS k", "id AS v").write.parquet(str(tmp_path / f"in{i}"))
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / f"in{i}")), "k", target, str(tmp_path / f"c{i}"), order="v", buckets=16).awaitTermination()

    run(0, 0, 500)
    assert len(list((tmp_path / "out").glob("_bucket=*"))) == 16
    run(1, 498, 503)
    stored = spark.read.parquet(target)
    assert stored.count() == 503 and stored.select("k").distinct().count() == 503
    buckets = [r["_bucket"] for r in stored.filter("k >= 498").select("_bucket").distinct().collect()]
    keys = stored_keys(spark, target, "k", buckets[:2])
    assert keys.count() == stored.filter(F.col("_bucket").isin(buckets[:2])).count() < 200
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan and "ReadSchema: struct<k:bigint>" in plan
    with pytest.raises(ValueError, match="another configuration"):
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in1")), "k", target, str(tmp_path / "c9"), order="v", buckets=8)


def test_keywords_in_leaves(spark, monkeypatch):
    words = ["Grey heron (GH)", "owl", "snow  owl", "# none", "", "C++", "été", "heron"]
    leaves = [("a", ["gh", None, "An old Gh.", "GREY\n  HERON!", "owlet prowl"]), ("b", ["Snow", "owl"]), ("c", ["a SNOW\towl"]), ("d", ["C++, c+++", "Été"]), ("e", []), ("f", None)]
    df = spark.createDataFrame(leaves, "k string, l array<string>")
    want = {("a", 0, "Grey heron (GH)"), ("a", 2, "Grey heron (GH)"), ("a", 3, "Grey heron (GH)"), ("a", 3, "heron"), ("b", 1, "owl"), ("c", 0, "owl"), ("c", 0, "snow owl"), ("d", 0, "C++"), ("d", 1, "été")}
    got = [tuple(r) for r in keywords.keyword_hits(df, "k", "l", words).collect()]
    assert set(got) == want and len(got) == len(want)
    monkeypatch.setattr(keywords, "PHRASE_BYTES", 20)
    assert sorted(tuple(r) for r in keywords.keyword_hits(df, "k", "l", words).collect()) == sorted(want)
    with pytest.raises(ValueError, match="no keywords"):
        keywords.keyword_hits(df, "k", "l", ["#", " "])


def test_many_keywords_in_one_pass(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 6))) for _ in range(20_000)]
    texts = [" ".join(rnd.choice("abcd") * 1 + rnd.choice(words) for _ in range(20)) for _ in range(40)]
    got = {(r.k, r.keyword) for r in keywords.keyword_hits(spark.createDataFrame(list(enumerate([[t] for t in texts])), "k int, l array<string>"), "k", "l", words).collect()}
    known = set(words)
    assert got == {(i, w) for i, t in enumerate(texts) for w in t.split() if w in known}


def clusters(n, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(20, 16))
    return [(i, (middle[rng.integers(20)] + rng.normal(size=16) * 0.4).tolist()) for i in range(n)]


def test_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PART_ROWS", 60)
    rows = clusters(1_500, 1) + [(9_000, None), (9_001, [0.0] * 16), (9_002, [float("nan")] * 16), (9_003, [1.0, 2.0])]
    rows += [(5_000 + i, rows[3][1]) for i in range(30)]  # equal vectors
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    path = str(tmp_path / "index")
    index.build(df, "id", "v", path, sample=400)
    stored = spark.read.parquet(f"{path}/rows")
    assert stored.count() == 1_530 and stored.groupBy("list", "part").count().agg(F.max("count")).first()[0] < 200
    asked = df.filter("id % 50 = 0")
    truth = vectors.top_k_cosine(asked, df.filter("size(v) = 16"), "id", "v", 10).cache()
    near = index.search(spark, path, asked, "id", "v", 10)
    assert index.recall(near, truth) >= 0.9
    exact = index.search(spark, path, asked, "id", "v", 10, probe=1, exact=True)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, truth.collect()))
    more = index.search(spark, path, asked.limit(1), "id", "v", 5_000, probe=1, exact=True)
    assert more.count() == 1_529
    assert index.search(spark, path, asked.limit(0), "id", "v", 3).count() == 0
    with pytest.raises(ValueError, match="no vector"):
        index.build(df.filter("id = 9000"), "id", "v", str(tmp_path / "none"))


def test_index_recall_on_tables(spark):
    from caravel.plans import catalogue

    sf = "/root/testdata/sf0.01"
    assert index.recall(catalogue.QUERIES["index_search"](spark, sf), catalogue.QUERIES["topk_block_matmul"](spark, sf)) >= 0.9


def test_scores_held_at_once_are_bounded(spark, monkeypatch):
    from caravel.operators import vectors

    rows = [(i, [float(i % 7) - 3, float(i % 5) - 2, 1.0]) for i in range(300)] + [(1000, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    want = vectors.top_k_cosine(df, df, "id", "v", 4).collect()
    monkeypatch.setattr(vectors, "SCORES", 1500)
    made = {}
    work = lambda self, f, shape: made.setdefault("f", f) and real(self, f, shape)
    real = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", work)
    assert vectors.top_k_cosine(df, df, "id", "v", 4).collect() == want
    batch = pa.RecordBatch.from_pylist([{"dims": 3, "block": 0, "asks": asks, "id": i, "grp": None, "v": v} for asks in (False, True) for i, v in rows], schema=pa.schema([("dims", pa.int32()), ("block", pa.int64()), ("asks", pa.bool_()), ("id", pa.int64()), ("grp", pa.string()), ("v", pa.list_(pa.float64()))]))
    assert [b.num_rows for b in made["f"](iter([batch]))] == [20] * 60
    narrow = vectors.top_k_cosine(df.filter("id = 1000"), df.filter("id = 1000"), "id", "v", 4)
    assert narrow.collect() == []

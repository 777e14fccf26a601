import csv
import json

import pytest
from pyspark.sql import functions as F

from caravel.functions import text
from caravel.operators import corpus, ordering, plugins, sampling, stats, vectors
from caravel.sources import qa, sinks
from caravel.streaming.ingest import hourly_counts, ingest, opened


def write_csv(path, rows):
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f)
        w.writerow(["image_path", "caption", "vqa_json"])
        w.writerows(rows)
    return str(path)


def test_csv_to_samples(spark, tmp_path):
    one = {"closed_ended": [{"question": "Is it dry?", "answer": False}], "open_ended": [{"question": "Which bird?", "answer": "a\nwren"}, {"question": "Where?"}]}
    two = {"single_choice": [{"question": "Which nest?", "answer": "A", "options": ["A. reed", "B. stone"], "image_path": "birds/../birds/nest.png"}]}
    path = write_csv(tmp_path / "train.csv", [["birds/wren.png", "first\nsecond", json.dumps(one)], ["['owl.png', 'tit.png']", "", json.dumps(two)]])
    samples = qa.flatten(qa.read_image_rows(spark, path, "train"))
    rows = samples.orderBy("row_index", "ord", "qa_index").collect()
    assert [r.id for r in rows] == ["mira:train:0:open_ended:0", "mira:train:0:open_ended:1", "mira:train:0:closed_ended:0", "mira:train:1:single_choice:0"]
    assert [r.missing_fields for r in rows] == [[], ["answer"], [], []]
    assert rows[2].answer == "false" and rows[3].images == ["birds/../birds/nest.png"]
    done = {r.id: r for r in qa.complete(samples).collect()}
    assert len(done) == 3 and done["mira:train:1:single_choice:0"].question == 'Which nest?\nOptions: ["A. reed","B. stone"]'
    assert [tuple(r) for r in qa.incomplete(samples).collect()] == [("train", "mira:train:0:open_ended:1", ["answer"])]
    assert [r.id for r in qa.after(samples, 0, "open_ended", 1).orderBy("row_index", "ord").collect()] == [r.id for r in rows[2:]]
    wanted = spark.createDataFrame([(0, rows[0].id), (1, rows[1].id)], "ord int, id string")
    kept, audit = qa.chosen_samples(wanted, samples, "skip")
    assert [r.id for r in kept.collect()] == [rows[0].id] and [r.id for r in audit.collect()] == [rows[1].id]
    with pytest.raises(ValueError, match="incomplete"):
        qa.chosen_samples(wanted, samples)
    with pytest.raises(ValueError, match="no such"):
        qa.chosen_samples(spark.createDataFrame([(0, "x")], "ord int, id string"), samples)


@pytest.mark.parametrize(("cell", "match"), [({"odd": []}, "unknown"), ({}, "no question"), ({"open_ended": []}, "no question"), ([1], "no object")])
def test_bad_rows_raise(spark, tmp_path, cell, match):
    path = write_csv(tmp_path / "train.csv", [["a.png", "", json.dumps(cell)]])
    with pytest.raises(Exception, match=f"row 1.*{match}"):
        qa.flatten(qa.read_image_rows(spark, path, "train")).collect()


def test_several_files_are_refused(spark, tmp_path):
    for name in "ab":
        write_csv(tmp_path / f"{name}.csv", [])
    with pytest.raises(ValueError, match="2 found"):
        qa.read_image_rows(spark, str(tmp_path), "train")


def test_image_names(spark):
    values = [("birds\\wren.png",), ('["a.png", " b.png "]',), ("('x.png',)",), ("a//b/../c.png",), ("a/b/c/d/e/../../../../../i.png",), ("../x/./y",), ("/../r.png",)]
    df = spark.createDataFrame(values, "p string").select(qa.image_list(F.col("p")).alias("l"))
    assert [r.l for r in df.collect()][:4] == [["birds/wren.png"], ["a.png", "b.png"], ["x.png"], ["a//b/../c.png"]]
    keys = [r.k for r in df.select(qa.image_keys(F.col("l")).alias("k")).collect()]
    assert keys[3:] == [["a/c.png"], ["i.png"], ["../x/y"], ["/r.png"]]
    got = spark.range(1).select(qa.placed(F.lit("a.png"), "/root/"), qa.placed(F.lit("/b.png"), "/root")).first()
    assert tuple(got) == ("/root/a.png", "/b.png")
    with pytest.raises(Exception, match="no local path"):
        spark.createDataFrame([("s3://b/c.png",)], "p string").select(qa.placed(F.col("p"), "/x")).collect()


def test_manifests(spark, tmp_path):
    def read(value, **more):
        path = tmp_path / "m.json"
        path.write_text(value if isinstance(value, str) else json.dumps(value))
        return {(r.role, r.ord, r.id) for r in qa.read_manifest(spark, str(path), **more).collect()}

    assert read({"train_ids": ["oak", "elm"], "test_ids": ["fir"]}) == {("train", 0, "oak"), ("train", 1, "elm"), ("test", 0, "fir")}
    assert read(["yew", "ash"]) == {("test", 0, "yew"), ("test", 1, "ash")}
    assert read({"train_ids": [], "test_ids": ["fir"]}) == {("test", 0, "fir")}
    for bad, match in (({"train_ids": ["oak"], "test_ids": ["oak"]}, "twice"), (["yew", "yew"], "twice"), ([" "], "empty"), (["mira:train:x"], "form")):
        with pytest.raises(ValueError, match=match):
            read(bad)
    with pytest.raises(ValueError, match="no train ids"):
        read({"train_ids": [], "test_ids": ["fir"]}, required=("train",))
    for bad in ({"ids": []}, "no json", '"text"'):
        with pytest.raises(Exception, match="no manifest"):
            read(bad)


def test_written_manifests(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    sinks.write_manifest(ids("oak", "elm", "oak"), ids("fir"), "id", f"{tmp_path}/m")
    assert sorted((r.role, r.id) for r in spark.read.json(f"{tmp_path}/m").collect()) == [("test", "fir"), ("train", "elm"), ("train", "oak")]
    with pytest.raises(ValueError, match="both roles"):
        sinks.write_manifest(ids("oak"), ids("oak"), "id", f"{tmp_path}/n")


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 25, None), (2, "", "x")], "id int, text string, note string")
    parts = sinks.chunk_rows(df, "id", "text", 10)
    assert {r.id: r.text for r in sinks.restored(parts, "id").collect()} == {1: "a" * 25, 2: ""}
    with pytest.raises(Exception, match="missing or repeated"):
        sinks.restored(parts.filter("part <> 1"), "id").collect()
    sinks.write_text(df, f"{tmp_path}/t", "note", "text")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t", wholetext=True).collect())[-1:] == ["x\n\n"] or "x\n" in open(next(tmp_path.glob("t/part*"))).read()
    sinks.write_summary(df.agg(F.count("*").alias("rows")), f"{tmp_path}/s", seed=3)
    assert spark.read.json(f"{tmp_path}/s").first().asDict() == {"rows": 2, "seed": 3}


def test_keyword_files(spark, tmp_path):
    words = tmp_path / "k.txt"
    words.write_text("﻿Snow owl\n\n# birds\nsnow  owl\nGrey\t heron\n", encoding="utf-8")
    assert qa.read_keywords(spark, str(words)) == ["Snow owl", "Grey heron"]
    words.write_text("# none\n")
    with pytest.raises(ValueError, match="no keywords"):
        qa.read_keywords(spark, str(words))


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"

    def read(text, *args, **more):
        path.write_text(text)
        return qa.read_json_lines(spark, str(path), *args, **more).collect()

    assert len(read('{"id": "1", "q": "x"}\n\nnope\n[1]\n{"id": null, "q": "y"}\n', ["id", "q"], strict=False)) == 1
    assert [r.line for r in read('{"id": "1"}\n\n {"id": "2"} \n', {"id": "STRING"}, key="id")] == [1, 3]
    for bad in ('{"id": "1"} trailing junk', '{"id": "1"} {"id": "2"}', '{"id": "1"}, {"id": "2"}', '{"id": "1"}] junk', '{"id": "1"}} junk', "[1]", '{"id": 3}', '{"id": null}', '{"a": "1"}'):
        with pytest.raises(Exception, match="bad line 2"):
            read('{"id": "0"}\n' + bad + "\n", {"id": "STRING"})
    with pytest.raises(ValueError, match="repeated or empty"):
        read('{"id": "1"}\n{"id": "1"}\n', ["id"], key="id")
    with pytest.raises(ValueError, match="repeated or empty"):
        read('{"id": " "}\n', ["id"], key="id")
    with pytest.raises(ValueError, match="no lines"):
        read("\n", ["id"])
    assert [(r.line, r.file) for r in read('{"id": "1"}\n\nnope\n{"id": "2"}\n', ["id"], strict=False)] == [(1, "x.jsonl"), (4, "x.jsonl")]
    assert [r.line for r in read('\ufeff{"id": "1"}\r\n\r\n{"id": "2"}\r\n', ["id"])] == [1, 3]


def test_lines_of_large_files_are_numbered(spark, tmp_path):
    """Files are read in many blocks; a line's number is its place in its own file."""
    for name, n in (("a", 5_000), ("b", 3_000), ("c", 1)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"n": {i}, "pad": "{"é" * (i % 90)}"}}\n' + "\n" * (i % 3) for i in range(n)))
    want = {}
    for name in "abc":
        for i, line in enumerate((tmp_path / f"{name}.jsonl").read_text().split("\n"), 1):
            if line:
                want[f"{name}.jsonl", i] = line
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = qa.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert {(r.file, r.line): r.value for r in rows.collect()} == want
        numbers = qa.read_json_lines(spark, str(tmp_path), {"n": "BIGINT"}).select("file", "line", F.variant_get("value", "$.n", "int").alias("n")).collect()
        assert {(r.file, r.line): r.n for r in numbers} == {k: json.loads(v)["n"] for k, v in want.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_evaluation_samples(spark, tmp_path):
    path = tmp_path / "x.jsonl"

    def read(*rows, **more):
        path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
        return qa.read_eval_samples(spark, str(path), **more).collect()

    base = {"id": 1, "question": "q", "reference": "r", "images": []}
    got = read(base, base | {"id": "2", "images": ["i.png", "/j.png"], "question_type": "open_ended", "options": ["a", "b"], "answer": {"text": "x"}, "extra": 3}, root="/data")
    assert [tuple(r) for r in got] == [("1", "q", "r", [], None, None, None), ("2", "q", "r", ["/data/i.png", "/j.png"], "open_ended", '["a","b"]', '{"text":"x"}')]
    for bad, match in (({"id": True}, "id"), ({"id": " "}, "id"), ({"id": 1.5}, "id"), ({"id": "mira:x"}, "id"), ({"question": " "}, "question"), ({"question": 3}, "question"), ({"reference": ""}, "reference"), ({"images": 5}, "images"), ({"images": "i.png"}, "images"), ({"images": [1]}, "images"), ({"images": [""]}, "images"), ({"images": None}, "")):
        with pytest.raises(Exception, match=f"bad line 2 of x.jsonl.*{match}"):
            read(base, base | {"id": 2} | bad)
    with pytest.raises(ValueError, match="repeated: 1"):
        read(base, base | {"id": "1"})
    with pytest.raises(Exception, match="bad line 1"):
        read({k: v for k, v in base.items() if k != "images"})


def test_generations(spark, tmp_path):
    for run, info in (("one", {"evaluation": {"judge": "x"}}), ("two", {"other": 1}), ("three", None)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "generations.jsonl").write_text("{}\n")
        if info:
            (tmp_path / run / "summary.json").write_text(json.dumps(info))
    found = qa.find_generations(spark, str(tmp_path))
    got = {r.run.rsplit("/", 1)[1]: r.e for r in qa.with_run_info(spark, found, str(tmp_path)).select("run", F.to_json("evaluation").alias("e")).collect()}
    assert got == {"one": '{"judge":"x"}', "two": None, "three": None}
    assert qa.find_generations(spark, str(tmp_path / "one" / "generations.jsonl")).count() == 1
    (tmp_path / "one" / "inner").mkdir()
    (tmp_path / "one" / "inner" / "generations.jsonl").write_text("{}\n")
    assert [r.file.rsplit("/", 2)[1] for r in qa.find_generations(spark, str(tmp_path / "one")).collect()] == ["one"]
    assert qa.find_generations(spark, str(tmp_path)).count() == 4
    (tmp_path / "none").mkdir()
    (tmp_path / "upper").mkdir()
    (tmp_path / "upper" / "Generations.JSONL").write_text("{}\n")
    assert qa.find_generations(spark, str(tmp_path / "upper" / "Generations.JSONL")).count() == 1
    with pytest.raises(ValueError, match="no generations"):
        qa.find_generations(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="must be named"):
        qa.find_generations(spark, str(tmp_path / "one" / "other.jsonl"))


def test_indexed_ids(spark):
    make = spark.createDataFrame
    collections = make([("c1", "main", "birds"), ("c2", "main", "trees"), ("c3", "main", "trees"), ("c4", "main", "empty")], "id string, database string, name string")
    segments = make([("s1", "c1", "METADATA"), ("s2", "c1", "VECTOR")], "id string, collection string, scope string")
    metadata = make([("s1", "a"), ("s1", "b"), ("s2", "x")], "segment string, embedding_id string")
    assert sorted(r.id for r in qa.indexed_ids(collections, segments, metadata, "main", "birds").collect()) == ["a", "b"]
    for name, match in (("fish", "no collection"), ("trees", "more than one collection"), ("empty", "no metadata segment")):
        with pytest.raises(ValueError, match=match):
            qa.indexed_ids(collections, segments, metadata, "main", name)
    with pytest.raises(ValueError, match="repeated or empty"):
        qa.indexed_ids(collections, segments, metadata.unionByName(metadata), "main", "birds")


def test_keywords(spark):
    words = ["grey heron (GH)", "owl"]
    yes = ["gh", "An old Gh.", "GREY\n  HERON", "Owl!"]
    no = ["ghost", "AGH", "owlet", "prowl", "herons", "grey herons"]
    got = spark.createDataFrame([(t,) for t in yes + no], "t string").select(corpus.mentions(F.array("t"), words).alias("m")).collect()
    assert [r.m for r in got] == [True] * len(yes) + [False] * len(no)
    assert not spark.range(1).select(corpus.mentions(F.array(F.lit("grey"), F.lit("heron")), words).alias("m")).first().m


def test_quotas():
    even = dict.fromkeys(sampling.TYPES, 1.0)
    assert list(sampling.allocate(11, even).values()) == [3, 3, 3, 2]
    assert list(sampling.allocate(5, even).values()) == [2, 1, 1, 1]


def test_type_quotas():
    assert sampling.type_counts({"multiple_choice": 1, "open_ended": 2, "single_choice": 0, "closed_ended": 3}) == {"open_ended": 2, "closed_ended": 3, "single_choice": 0, "multiple_choice": 1}
    assert sampling.type_ratios(dict.fromkeys(sampling.TYPES, 2)) == dict.fromkeys(sampling.TYPES, 0.25)
    even = dict.fromkeys(sampling.TYPES, 1)
    for bad in ({"open_ended": 1}, even | {"other": 1}, even | {"open_ended": -1}, even | {"open_ended": True}, even | {"open_ended": 1.0}, dict.fromkeys(sampling.TYPES, 0)):
        with pytest.raises(ValueError):
            sampling.type_counts(bad)
    for bad in (float("nan"), float("inf"), -0.5, True, "1"):
        with pytest.raises(ValueError):
            sampling.type_ratios(even | {"open_ended": bad})
    with pytest.raises(ValueError):
        sampling.allocate(3, {"a": float("nan"), "b": 1.0})


def test_forms_of_ids(spark):
    forms = lambda k, p: spark.range(1).select(F.struct(*[c.alias(n) for n, c in text.key_forms(F.lit(k), p).items()]).alias("f")).first().f.asDict()
    assert forms("mira:train:3:open_ended:0", "x-") == {"as_is": "mira:train:3:open_ended:0", "prefix": "x-mira:train:3:open_ended:0", "bare": "train:3:open_ended:0", "prefix_previous": "x-mira:train:3:open_ended:-1", "previous": "mira:train:3:open_ended:-1", "prefix_next": "x-mira:train:3:open_ended:1", "next": "mira:train:3:open_ended:1"}
    assert list(forms("a:b", "")) == ["as_is", "prefix", "bare", "prefix_previous", "previous", "prefix_next", "next"] and set(forms("a:b", "").values()) == {"a:b"}
    keys = spark.createDataFrame([(f"t:{i}:{i % 3}",) for i in range(20)], "id string")
    index = spark.createDataFrame([(f"p-t:{i}:{i % 3 + 1}",) for i in range(15)], "k string")
    form, found = vectors.reconciled(keys, "id", text.key_forms(F.col("id"), "p-"), index, "k")
    assert form == "prefix_next" and found.filter("id = 't:4:1'").first().stored == "p-t:4:2" and found.count() == 20
    with pytest.raises(ValueError, match="no form"):
        vectors.reconciled(keys, "id", text.key_forms(F.col("id"), "z-"), index, "k")


def test_cells_of_sheets(spark):
    rows = [("=1",), (" \t=1",), ("-x",), ("a=1",), (None,), ("x" * 101,), ("@" + "y" * 100,)]
    got = [r.t for r in sinks.sheet(spark.createDataFrame(rows, "t string"), 100).collect()]
    assert got == ["'=1", "' \t=1", "'-x", "a=1", None, "x" * 60 + sinks.CUT_NOTICE, "'@" + "y" * 58 + sinks.CUT_NOTICE]


def test_shuffled_splits(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS v")
    ids = lambda pair: tuple({r.id for r in x.collect()} for x in pair)
    train, test = ids(sampling.shuffled_split(df, "id", 30))
    assert len(test) == 30 and train == set(range(100)) - test and ids(sampling.shuffled_split(df.repartition(9), "id", 30)) == (train, test)
    first, second = ids(sampling.shuffled_split(df, "id", 20, 50))
    assert len(first) == 50 and len(second) == 20 and not first & second and test <= first
    assert [len(x) for x in ids(sampling.shuffled_split(df, "id", 20, 95))] == [95, 5]
    for bad in ((100,), (0,), (5, 0)):
        with pytest.raises(ValueError):
            sampling.shuffled_split(df, "id", *bad)


def test_python_lists_of_images(spark):
    cells = [(r"""['it\'s.png', "a 'b'.png"]""", ["it's.png", "a 'b'.png"]), ("('one.png',)", ["one.png"]), ("[broken", None), ("('x')", None), (" plain.png ", ["plain.png"]), ("""["j's.png"]""", ["j's.png"]), (None, [])]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cells)], "i int, t string").select("i", qa.image_list(F.col("t")).alias("l")).collect()
    assert [r.l for r in sorted(got)] == [w for _, w in cells]


def test_audits_and_indexes(spark, tmp_path):
    left = spark.createDataFrame([("b", ["answer"]), ("a", ["question"])], "id string, missing_fields array<string>")
    assert sinks.write_selection_audit(left, str(tmp_path / "audit"), policy="skip", manifest=None) == 2
    assert [r.id for r in spark.read.json(str(tmp_path / "audit" / "left_out")).orderBy("id").collect()] == ["a", "b"]
    assert json.loads(next((tmp_path / "audit" / "policy").glob("part*")).read_text()) == {"left_out": 2, "policy": "skip", "manifest": None}
    rows = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(5)], "k long, v array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    config = {"model": {"name": "m", "weights": [["a", 3]]}, "pooling": "mean", "space": "cosine"}
    target = str(tmp_path / "index")
    ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", target, str(tmp_path / "c"), order="k", config=config).awaitTermination()
    from caravel.streaming.ingest import open_index

    assert open_index(spark, target, config, 2, "v").count() == 5
    for more, match in (({"pooling": "last"}, "pooling"), ({"model": {"name": "m", "weights": [["a", 4]]}}, "model.weights"), ({"space": "l2"}, "space")):
        with pytest.raises(ValueError, match=match):
            open_index(spark, target, config | more, 2, "v")
    with pytest.raises(ValueError, match="2 components instead of 3"):
        open_index(spark, target, config, 3, "v")
    with pytest.raises(ValueError, match="no index"):
        open_index(spark, str(tmp_path / "none"), config, 3, "v")


def test_fingerprints_of_generations(spark):
    df = spark.createDataFrame([("b", "q", ["i"]), ("a", None, [])], "id string, q string, images array<string>")
    own = ordering.table_digest(df, "id", "q", "images")
    assert own == ordering.table_digest(df.repartition(3), "id", "q", "images") != ordering.table_digest(df.fillna(""), "id", "q", "images")
    assert ordering.table_digest(df.limit(0), "id") == ""
    base = {"data": own, "tests": own, "model": {"name": "m"}, "settings": {"seed": 1}, "prompts": {}, "versions": {"torch": "2", "adapter": "1"}}
    mark = lambda **more: plugins.generation_fingerprint(**(base | more))
    assert mark() == mark(encoder={"x": 1}, index={"y": 2}) == mark(versions={"torch": "2", "adapter": "9"})
    assert len({mark(), mark(top_k=3), mark(top_k=3, knowledge="k"), mark(adapter={"p": 1}), mark(settings={"seed": 2}), mark(adapter={"p": 1}, versions={"torch": "2", "adapter": "9"})}) == 6


def test_keys_of_selections():
    key = lambda **more: plugins.selection_key(**({"data": "d", "reserved": "r", "seed": 1} | more))
    assert key(kinds=["b", "a"]) == key(kinds=["a", "b"]) and len({key(), key(seed=2), key(count=3), key(knowledge=3), key(kinds=["a"]), key(shared="images"), key(data="e")}) == 7


def test_roles_whose_ids_need_a_form(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"train_ids": ["mira:train:1:open_ended:0"], "test_ids": ["mira:odd"]}))
    with pytest.raises(ValueError, match="form"):
        qa.read_manifest(spark, str(tmp_path / "m.json"))
    assert qa.read_manifest(spark, str(tmp_path / "m.json"), formed=("train",)).count() == 2


def test_budget(spark):
    values = [(0,), (5,), (8,), (100,)]
    got = spark.createDataFrame(values, "n long").select(text.token_budget(F.col("n"), 1.5, 3, 10, 20).alias("b")).collect()
    assert [r.b for r in got] == [10, 11, 15, 20]


def test_thinking(spark):
    r = spark.range(1).select(text.without_thinking(F.lit("<think>a</think> b")).alias("a"), text.without_thinking(F.lit("<think>a")).alias("b"), text.final_text(F.lit("x <think>y")).alias("c"), text.after_thinking(F.lit("a</think>\n z")).alias("d")).first()
    assert tuple(r) == ("b", None, "x", "z")


def test_wilson(spark):
    low, high = stats.wilson(F.lit(1.0), F.lit(35))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert r.l == pytest.approx(0.9010990077) and r.h == pytest.approx(1.0)


def test_index_grows_once(spark):
    samples = spark.createDataFrame([("a", "x y"), ("b", "z"), ("b", "z")], "id string, text string")
    first = plugins.add_missing(spark.createDataFrame([], "id string"), samples.filter("id = 'a'"), "id", "text")
    assert [r.id for r in plugins.add_missing(first, samples, "id", "text").collect()] == ["b"]


def test_failed_batch_is_null(spark):
    rows = [("a", True, True), ("a", False, True), ("b", True, True), ("b", True, False)]
    got = plugins.supported_share(spark.createDataFrame(rows, "k string, s boolean, good boolean"), "k", "s", "good").collect()
    assert {r.k: r.factscore for r in got} == {"a": 0.5, "b": None}


def test_ingest_is_idempotent(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(100).selectExpr("nullif(id % 50, 7) AS k", "id AS v").repartition(4).write.parquet(source)
    schema = spark.read.parquet(source).schema
    run = lambda i, **more: ingest(spark.readStream.schema(schema).parquet(source), "k", target, str(tmp_path / f"c{i}"), order="v", **more).awaitTermination()
    for i in range(2):
        run(i, config={"dims": 3})
    stored = spark.read.parquet(target)
    assert stored.count() == 50 and stored.filter("k is null").count() == 1 and stored.filter("v >= 50").count() == 0
    with pytest.raises(ValueError, match="another configuration"):
        run(2, config={"dims": 4})
    stored.limit(10).write.parquet(f"{target}-small")
    spark.read.parquet(f"{target}-runs").write.parquet(f"{target}-small-runs")
    with pytest.raises(ValueError, match="fewer rows"):
        opened(spark, f"{target}-small", {"dims": 3})


def test_hourly_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).selectExpr("timestamp_seconds(id * 600) AS ts", "'x' AS kind").write.parquet(source)
    out = hourly_counts(spark.readStream.schema("ts timestamp, kind string").parquet(source), "ts", "kind")
    q = out.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM hours").first()[0] == 100

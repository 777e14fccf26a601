"""Evaluation operators, sampling runs, rendering and reports on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from caravel.functions import judgements, nested, render, report, text, training
from caravel.operators import evaluation, ordering, runs, sampling, stats, vectors


class Judge:
    """Answers from a script; counts how often it is asked."""

    def __init__(self, path):
        self.path = str(path)

    def text(self, prompt, max_new_tokens):
        with open(self.path, "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        if "broken" in prompt:
            raise MemoryError("no room")
        if "never" in prompt or ("twice" in prompt and not prompt.startswith("Answer in")):
            return "0.5"
        return json.dumps({"correctness": 1, "reason": "r"})


def test_judged(spark, tmp_path):
    judge = Judge(tmp_path / "asked")
    rows = spark.createDataFrame([(1, "fine"), (2, "fine"), (3, "twice"), (4, "never"), (5, "broken"), (6, None)], "id int, prompt string")
    scored, fresh = evaluation.judged(rows, "id", "prompt", judge, judgements.read_judgement, model="m")
    got = {r.id: r for r in scored.collect()}
    assert {i: r.attempts for i, r in got.items()} == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1, 6: 1}
    assert {i: r.parsed is None for i, r in got.items()} == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False}
    assert got[5].error == "MemoryError: no room" and got[4].error.startswith("keys") and not any(r.from_cache for r in got.values())
    assert sum(line == "fine" for line in (tmp_path / "asked").read_text().splitlines()) == 1
    cache = spark.createDataFrame([(got[1].fingerprint, got[1].raw), (got[3].fingerprint, "0.5"), ("x", "y")], "fingerprint string, raw string")
    again = {r.id: r for r in evaluation.judged(rows, "id", "prompt", judge, judgements.read_judgement, cache, model="m")[0].collect()}
    assert {i for i, r in again.items() if r.from_cache} == {1, 2}  # what can't be read any more isn't trusted
    other = evaluation.judged(rows, "id", "prompt", judge, judgements.read_judgement, cache, model="other")[0]
    assert not any(r.from_cache for r in other.collect())
    assert fresh.count() == 3
    assert evaluation.judged(rows.limit(0), "id", "prompt", judge, judgements.read_judgement)[0].count() == 0


class CountedJudge:
    def __init__(self, path):
        self.path = str(path)

    def text(self, prompt, max_new_tokens):
        with open(self.path, "a") as f:
            f.write("asked\n")
        return ('{"correctness": 1, "reason": "cut here"}', "long" in prompt)


def test_prompts_are_asked_once_whatever_is_read(spark, tmp_path):
    judge, asked = CountedJudge(tmp_path / "n"), lambda: len((tmp_path / "n").read_text().splitlines())
    rows = spark.createDataFrame([(i, f"prompt {i % 5}") for i in range(20)], "id int, prompt string")
    scored, fresh = evaluation.judged(rows, "id", "prompt", judge, judgements.read_judgement)
    assert scored.count() == 20 and asked() == 5
    kept = fresh.collect()
    assert len(kept) == 5 and {r.stage for r in kept} == {"judge"} and asked() == 5
    cache = spark.createDataFrame(kept)
    again, more = evaluation.judged(rows, "id", "prompt", judge, judgements.read_judgement, cache)
    assert again.filter("from_cache").count() == 20 and more.count() == 0 and asked() == 5
    other, _ = evaluation.judged(rows, "id", "prompt", judge, judgements.read_judgement, cache, stage="other")
    assert other.filter("from_cache").count() == 0 and asked() == 10


def test_cut_answers_fail(spark, tmp_path):
    rows = spark.createDataFrame([(1, "short"), (2, "long")], "id int, prompt string")
    scored, fresh = evaluation.judged(rows, "id", "prompt", CountedJudge(tmp_path / "n"), judgements.read_judgement)
    got = {r.id: (r.parsed is None, r.error, r.attempts) for r in scored.collect()}
    assert got == {1: (False, None, 1), 2: (True, "the answer was cut", 1)} and fresh.count() == 1


class FactJudge:
    """Facts are the words of an answer; those of an even length are supported; ``lost`` can't be listed, ``odd`` not checked."""

    def text(self, prompt, max_new_tokens):
        task, _, about = prompt.partition("\n") if not prompt.startswith("Answer in") else prompt.split("\n", 1)[1].partition("\n")
        given = json.loads(about)
        if task == "mean":
            return json.dumps({"correctness": 0.5, "reason": given["prediction"]})
        if task == "list":
            return "?" if "lost" in given["prediction"] else json.dumps({"facts": given["prediction"].split()})
        ids = [c["id"] for c in given["claims"]]
        if any(c["claim"] == "odd" for c in given["claims"]):
            ids = ids[:-1]
        return json.dumps({"verdicts": [{"id": i, "supported": len(c["claim"]) % 2 == 0, "reason": "r"} for i, c in zip(ids, given["claims"])]})


def test_fact_precision(spark):
    rows = [("a", "q", "r", "ab abc abcd abcde abcdef"), ("b", "q", "r", "<think>x</think> "), ("c", "", "r", "ab"), ("d", "q", "r", None), ("e", "q", "r", "lost"), ("f", "q", "r", "ab cd ef odd"), ("g", "q", "r", "ab")]
    df = spark.createDataFrame(rows, "id string, question string, reference string, prediction string")
    scores, fresh = evaluation.fact_precision(df, "id", "question", "reference", "prediction", FactJudge(), ("list", "check"), size=2)
    got = {r.id: (r.factscore, r.facts, r.supported, r.fact_status) for r in scores.collect()}
    assert got == {"a": (0.6, 5, 3, "ok"), "b": (0.0, 0, 0, "ok"), "c": (None, None, None, "judge_failed"), "d": (None, None, None, "judge_failed"), "e": (None, None, None, "judge_failed"), "f": (None, 4, None, "judge_failed"), "g": (1.0, 1, 1, "ok")}
    assert {r.stage for r in fresh.collect()} == {"extract", "verify"}


def test_only_what_is_pending_is_judged(spark):
    rows = [("a", True, True, None, None, None, "pending"), ("b", False, True, None, None, 1.0, "ok"), ("c", True, False, 0.25, "ok", None, None), ("d", False, False, None, None, None, None)]
    df = spark.createDataFrame([(i, "q", "r", "ab abc", *x) for i, *x in rows], "id string, question string, reference string, prediction string, fact_required boolean, semantic_required boolean, factscore double, fact_status string, semantic double, semantic_status string")
    out, fresh = evaluation.judge_pending(df, "id", FactJudge(), ("list", "check", "mean"))
    assert out.columns == df.columns
    got = {r.id: (r.factscore, r.fact_status, r.semantic, r.semantic_status) for r in out.collect()}
    assert got == {"a": (0.5, "ok", 0.5, "ok"), "b": (None, "not_required", 1.0, "ok"), "c": (0.25, "ok", None, "not_required"), "d": (None, "not_required", None, "not_required")}
    assert sorted(r.stage for r in fresh.collect()) == ["extract", "semantic", "verify"]


def test_missing_batches_have_no_score(spark):
    facts = spark.createDataFrame([(1, ["x", "y", "z"]), (2, ["x"])], "id int, facts array<string>")
    batches = evaluation.claim_batches(facts, "id", "facts", 2)
    said = batches.filter("not (id = 1 and batch = 1)").withColumn("raw", F.to_json(F.struct(F.transform("claims", lambda c: F.struct(c["id"].alias("id"), F.lit(True).alias("supported"), F.lit("r").alias("reason"))).alias("verdicts"))))
    assert {r.id: r.factscore for r in evaluation.fact_scores(said, "id", "raw", "claims", batches).collect()} == {1: None, 2: 1.0}
    assert {r.id: r.factscore for r in evaluation.fact_scores(said, "id", "raw", "claims").collect()} == {1: 1.0, 2: 1.0}


def test_running_sums(spark):
    rows = [("a" if i % 3 else None, i, i % 4) for i in range(300)] + [("b", i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, k int, w int").repartition(5)
    got = {(r.g, r.k): (r.at, r.before) for r in ordering.running(ordering.running(df, ["g"], ["k"], into="at", tasks=7), ["g"], ["k"], F.col("w"), tasks=6).collect()}
    want, at, total = {}, {}, {}
    for g, k, w in sorted(rows, key=lambda r: r[1]):
        want[g, k] = at.get(g, 0), total.get(g, 0)
        at[g], total[g] = at.get(g, 0) + 1, total.get(g, 0) + w
    assert got == want


def test_digest_trees(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [("a", i, sha(f"a{i}")) for i in range(70)] + [("b", i, sha(f"b{i}")) for i in range(3)] + [(None, 1, sha("x"))]
    got = {r.g: r.digest for r in ordering.ordered_digest(spark.createDataFrame(rows, "g string, k int, d string").repartition(4), "g", "k", "d", 5, 3).collect()}
    for g in ("a", "b", None):
        level = [d for x, _, d in sorted(rows, key=lambda r: r[1]) if x == g]
        for _ in range(3):
            level = [sha("".join(level[i : i + 5])) for i in range(0, len(level), 5)]
        assert [got[g]] == level
    one = evaluation.run_record(spark.createDataFrame([(None, 1, 2.0, "x")], "g string, k int, s double, v string"), "g", "k", "s", "v").collect()
    assert len(one) == 1 and one[0].samples == 1


def test_detail_sheet(spark):
    rows = spark.createDataFrame([("1", "single_choice", "r", 0.5, ("x",)), ("2", None, "r", None, None)], "id string, kind string, reference string, m double, answer_details struct<a:string>")
    got = evaluation.detail(rows, "run", ["m"], F.when(F.col("id") == "1", "why").otherwise(""), {"single_choice": "one of many"}).collect()
    assert got[0].asDict() == {"run": "run", "id": "1", "question_type": "one of many", "question": None, "answer": "r", "reference": "r", "prediction": None, "normalized_prediction": None, "normalized_reference": None, "m": 50.0, "status": None, "answer_details": '{"a":"x"}', "fact_status": None, "fact_reason": None, "semantic_status": None, "semantic_reason": None, "explanation_status": None, "generation_info": None, "retrieved_count": 0, "needs_review": True, "reasons": "why"}
    assert got[1].question_type is None and not got[1].needs_review


def test_pairs_of_runs(spark):
    rows = [("f1", True, "m", "x", "m1", False, "i"), ("b1", False, "m", "x", "m1", False, "j"), ("b2", False, "m", "x", "m1", False, "j"), ("f2", True, "m", "y", None, True, "i"), ("b3", False, "m", "y", None, False, "i"), ("b4", False, "m", "y", None, False, "i"), ("f3", True, "m", "z", "", True, "i"), ("b5", False, "m", "z", None, True, "i"), ("b6", False, "m", "z", "", True, "i"), ("b7", False, "m", "z", "", True, "k")]
    df = spark.createDataFrame(rows, "name string, fine boolean, model string, data string, identity string, uses boolean, folder string")
    pairs = lambda *a, **b: {tuple(r) for r in runs.compatible_pairs(df, "name", F.col("fine"), ["model", "data"], *a, **b).collect()}
    assert pairs() == {("f1", "b1"), ("f1", "b2"), ("f2", "b3"), ("f2", "b4"), ("f3", "b5"), ("f3", "b6"), ("f3", "b7")}
    assert pairs("identity") == {("f1", "b1"), ("f1", "b2")}
    assert pairs(retrieves="uses", index_fields=["folder"]) == {("f1", "b1"), ("f1", "b2"), ("f2", "b3"), ("f2", "b4"), ("f3", "b5"), ("f3", "b6")}


def test_claims_are_cut_where_they_lie(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"]), (2, []), (3, None), (4, ["x"])], "id long, facts array<string>")
    made = evaluation.claim_batches(df, "id", "facts", 2)
    assert {(r.id, r.batch): [tuple(c) for c in r.claims] for r in made.collect()} == {(1, 0): [(1, "a"), (2, "b")], (1, 1): [(3, "c"), (4, "d")], (1, 2): [(5, "e")], (4, 0): [(1, "x")]}
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_one_group_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 16)
    df = spark.range(0, 400, 1, 1).select("id", F.when(F.col("id") < 0, "m").alias("model"))
    pairs = runs.compatible_pairs(df, "id", F.col("id") % 4 == 0, ["model"])
    each = [r["n"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(each) == 100 * 300 and max(each) < 0.75 * sum(each)
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in range(0, 400, 4) for b in range(400) if b % 4}


def test_pairs_are_compared_at_once(spark):
    rows = [("f", i, float(i), i % 2 == 0) for i in range(4)] + [("b", i, 1.0 if i else None, True) for i in range(4)] + [("c", i, 0.0, True) for i in range(3)]
    df = spark.createDataFrame(rows, "run string, id int, m double, ok boolean")
    pairs = spark.createDataFrame([("f", "b")], "fine string, base string")
    got = {r.metric: (r.n, r.total, r.delta) for r in evaluation.paired_runs(df.withColumn("all", F.col("m")), pairs, "run", "id", {"m": F.col("ok"), "all": None}).collect()}
    assert got == {"m": (1, 2, 1.0), "all": (3, 4, 1.0)}
    for wrong, other in ((df, [("f", "c")]), (df.unionByName(df.filter("run = 'f'")), [("f", "b")]), (df, [("f", "none")])):
        with pytest.raises(ValueError, match="other keys: f and"):
            evaluation.paired_runs(wrong, spark.createDataFrame(other, "fine string, base string"), "run", "id", {"m": None})


def test_cached_records(spark):
    item = "struct<id:string,question:string,reference:string,images:array<string>,similarity:double>"
    sample = "id string, question string, reference string, images array<string>"
    samples = spark.createDataFrame([("t1", "q", "r", ["i"]), ("t2", "q2", None, [])], sample)
    known = spark.createDataFrame([("k1", "a", "b", ["x"]), ("k2", "c", "d", [])], sample)
    one, two = ("k1", "a", "b", ["x"], 0.5), ("k2", "c", "d", [], 1.0)
    rows = [("t1", "gen", 1, "fp", "q", "r", ["i"], "old", [one, two]), ("t1", "pre", 1, "fp", "q", "r", ["i"], "new", [two, one]), ("t2", "gen", 2, "fp", "q2", None, [], "p", [two, one]), ("t2", "pre", 5, "fp", "q2", "r", [], None, None), ("t2", "pre", 6, "no", "q2", None, [], "p", [one, one]), ("t9", "pre", 7, "fp", "q", "r", [], "p", [("t1", "q", "r", ["i"], 0.1), ("zz", "", "", [], float("inf"))])]
    cache = spark.createDataFrame(rows, f"id string, file string, line int, fingerprint string, question string, reference string, images array<string>, prediction string, evidence array<{item}>")
    got = {(r.file, r.line): r.defects for r in runs.cache_defects(cache, samples, known, "id", "fp", 5).collect()}
    assert got == {("gen", 1): [], ("pre", 1): [], ("gen", 2): [], ("pre", 5): ["content", "evidence_count", "prediction"], ("pre", 6): ["evidence_repeated", "fingerprint"], ("pre", 7): ["evidence_similarity", "evidence_tested", "evidence_unknown", "no_sample"]}
    assert {r.id: r.prediction for r in runs.valid_cache(cache, samples, known, "id", "fp", 5).collect()} == {"t1": "new", "t2": "p"}
    assert runs.valid_cache(cache, samples, known, "id", "fp", 0).count() == 0


def test_strict_answers_of_judges():
    assert judgements.read_facts('{"facts": [" a ", "b"]}') == ["a", "b"]
    for bad in ('{"facts": ["A b", "a  B"]}', '{"facts": [""]}', '{"facts": [1]}', '{"facts": [], "x": 1}', "[]", '{"facts": ["a"'):
        with pytest.raises(ValueError):
            judgements.read_facts(bad)
    verdict = lambda i, s="true": f'{{"id": {i}, "supported": {s}, "reason": "r"}}'
    read = lambda *v: judgements.read_verdicts('{"verdicts": [' + ", ".join(v) + "]}", [1, 2])
    assert [v["id"] for v in read(verdict(2), verdict(1))] == [1, 2]
    for bad in ([verdict(1)], [verdict(1), verdict(1)], [verdict(1), verdict(3)], [verdict(1), verdict(2, "1")], [verdict(1), verdict("true")], [verdict(1), verdict(2, '"true"')]):
        with pytest.raises(ValueError):
            read(*bad)
    assert judgements.read_claims('```json\n["x", " x", "y"]\n```') == ["x", "y"]
    with pytest.raises(ValueError):
        judgements.read_claims('["x", 1]')


def test_scored_runs(spark):
    samples = spark.createDataFrame([("a", "closed_ended", None, "Yes"), ("b", "closed_ended", None, "No"), ("c", "open_ended", None, "x")], "id string, kind string, options string, reference string")
    made = spark.createDataFrame([("a", "Yes", ["k"]), ("b", "perhaps", ["l"])], "id string, prediction string, evidence array<string>")
    got = {r.id: (r.status, r.accuracy) for r in evaluation.scored_run(samples, made, "id").collect()}
    assert got == {"a": ("ok", 1.0), "b": ("prediction_unparseable", 0.0), "c": ("prediction_unparseable", None)}
    with pytest.raises(ValueError, match="reserved"):
        evaluation.scored_run(samples, made, "id", spark.createDataFrame([("l",)], "id string"))
    with pytest.raises(Exception, match="no sample"):
        evaluation.scored_run(samples.filter("id <> 'a'"), made, "id").collect()
    with pytest.raises(ValueError, match="one run only: c"):
        evaluation.equal_keys(samples, made, "id")
    with pytest.raises(ValueError, match="repeated"):
        evaluation.equal_keys(samples, samples.unionByName(samples), "id")
    assert evaluation.equal_keys(samples, samples, "id")[0] is samples
    same = spark.createDataFrame([("r", "f"), ("s", "f")], "run string, f string")
    assert evaluation.one_test_set(same, "f") and not evaluation.one_test_set(same, "run")
    flags = samples.select(evaluation.applies("choice_f1", F.col("kind")).alias("a"), evaluation.applies("factscore", F.col("kind"), {"factscore": F.col("id") == "c"}).alias("b"), evaluation.applies("bleu", F.col("kind")).alias("c"))
    assert [tuple(r) for r in flags.collect()] == [(False, False, True), (False, False, True), (False, True, True)]


def test_type_report_has_all_types(spark):
    rows = spark.createDataFrame([("base", "open_ended", 0.5), ("new", "open_ended", 0.75), ("new", "closed_ended", None)], "run string, kind string, m double")
    got = {(r.run, r.kind): (r.n, r.percent, r.delta) for r in evaluation.type_report(rows, "run", "kind", ["m"], "base").collect()}
    assert len(got) == 8 and got["new", "open_ended"] == (1, 75.0, 25.0) and got["new", "closed_ended"] == (0, None, None)
    lines = evaluation.markdown(evaluation.type_report(rows, "run", "kind", ["m"], "base").filter("run = 'new' and kind = 'closed_ended'"), "run", "n", "percent").collect()
    assert lines[0].line == "| new | 0 | - |"


def population(spark, n=60):
    rows = [(i, sampling.TYPES[i % 4], [str(i // 8)], i % 3 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, category string, images array<string>, word boolean")
    return sampling.tagged(df, "id", spark.createDataFrame([(i,) for i in range(0, n, 2)] * 2, "k int"), "k", F.col("word"))


def test_sampling_run(spark):
    rows = population(spark)
    assert {r.tier for r in rows.filter("id % 6 = 0").collect()} == {0} and rows.count() == 60
    got = sampling.sample_roles(rows, "id", "category", dict.fromkeys(sampling.TYPES, 2), dict.fromkeys(sampling.TYPES, 3), 1, "images").collect()
    test, train = ({r.id for r in got if r.role == role} for role in ("test", "train"))
    assert len(test) == 8 and len(train) == 12 and not {i // 8 for i in test} & {i // 8 for i in train}
    again = sampling.sample_roles(rows.repartition(7), "id", "category", dict.fromkeys(sampling.TYPES, 2), dict.fromkeys(sampling.TYPES, 3), 1, "images").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    with pytest.raises(ValueError, match="too few samples: open_ended: 9 \\+ 9 asked, 15 there"):
        sampling.sample_roles(rows, "id", "category", {"open_ended": 9}, {"open_ended": 9}, 1)
    with pytest.raises(ValueError, match="outside the test"):
        sampling.sample_roles(rows, "id", "category", {"open_ended": 7}, {"open_ended": 8}, 1, "images")


def test_evaluation_split(spark):
    rows = population(spark)
    reserved = spark.createDataFrame([(i, i) for i in range(0, 40, 5)], "ord int, id int")
    test, rest = sampling.evaluation_split(rows, "id", reserved, 2, shared="images")
    assert sorted(r.id for r in test.collect()) == [0, 5]
    left = {r.id for r in rest.collect()}
    assert not left & set(range(0, 40, 5)) and not left & set(range(8)) and {9, 41} <= left
    with pytest.raises(ValueError, match="not in the data: 99"):
        sampling.evaluation_split(rows, "id", spark.createDataFrame([(0, 99)], "ord int, id int"))
    for bad, match in (([(0, 1), (1, 1)], "repeated"), ([], "no id"), ([(0, None)], "empty")):
        with pytest.raises(ValueError, match=match):
            sampling.require_unique(spark.createDataFrame(bad, "ord int, id int"), "id")


def test_rendering(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(render.sample_document(F.lit("q"), F.lit("{}"), F.lit('["a"]'), F.lit('{"x":1}'), F.lit(None).cast("string"))) == 'Question: q\nOptions: ["a"]\nAnswer: [not provided in source]\nAdditional fields: {"x":1}'
    assert [tuple(one(F.struct(*render.support_label(F.lit(x))))) for x in ("支持", " “部分支持” 。", "很支持", "不支持")] == [("支持", True), ("部分支持", True), ("不支持", False), ("不支持", True)]
    assert one(render.claim_lines(F.lit(None).cast("array<struct<claim:string,label:string,score:double,valid:boolean>>"))) == "  (no claims)"
    key = lambda j: one(render.canonical_key(F.parse_json(F.lit(j))))
    assert key("1") == key('" 1 "') == "1"
    for bad in ("true", '""', "[1]", "1.5"):
        with pytest.raises(Exception, match="an id is"):
            key(bad)
    assert one(render.lines_of(F.parse_json(F.lit('["a", 2, null]')))) == "a\n2\n" and one(render.lines_of(F.parse_json(F.lit("null")))) == "" and one(render.lines_of(F.parse_json(F.lit('{"a":1}')))) == '{"a":1}'
    assert render.safe_name("run-1.a") == "run-1.a"
    for bad in ("", "con", "NUL.txt", "a/b", ".a", "a.", "x" * 99):
        with pytest.raises(ValueError):
            render.safe_name(bad)
    assert [one(text.masked_key(F.lit(k))) for k in (None, "", "short", "abcdefghijkl")] == ["<empty>", "<empty>", "<set>", "abcd...ijkl"]
    assert [one(text.shifted_tail(F.lit(k), 1)) for k in ("a:b:3", "a:3", "a:b:x")] == ["a:b:4", "a:3", "a:b:x"]


def test_supervised_rows(spark):
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(training.supervised_row(ids(1, 2), ids(3, 4), 4)) == ([1, 2, 3, 4], [-100, -100, 3, 4], 2, False)
    assert one(training.supervised_row(ids(1, 2), ids(3, 4), 3, "cut")) == ([1, 2, 3], [-100, -100, 3], 1, True)
    assert one(training.supervised_row(ids(1, 2), ids(3, 4), 2, "cut")) is None
    assert one(training.supervised_row(ids(1, 2), ids(3, 4), 3, "skip")) is None
    with pytest.raises(Exception, match="more than 3"):
        one(training.supervised_row(ids(1, 2), ids(3, 4), 3))


def test_reports(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    diagnosis, findings = report.summary_by_rule({"年龄": F.lit(" "), "": F.lit(None).cast("string")}, F.lit(""), F.lit(None).cast("string"), F.lit("LDL-C 高血压"))
    assert one(findings) == "相关线索：高血压\n相关线索：LDL-C" and one(diagnosis) == report.CONCLUSIONS[0][1]
    assert one(report.summary_by_rule({}, F.lit(""), F.lit(""), F.lit(""))[1]) == report.NO_FINDINGS
    rest = {"diagnosis": F.lit("d")}
    assert one(report.report_of(F.lit('{"x": 1} {"advice": "a"}'), rest)).advice == "a"
    assert one(report.report_of(F.lit("x"), rest)).diagnosis == "d"


def test_top_k_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rows = [(i, [float(i % 5), 1.0, float(i % 3)], "g" if i % 2 else None) for i in range(40)] + [(90, None, "g"), (91, [0.0, 0.0, 0.0], "g"), (92, [float("nan")] * 3, "g")]
    df = spark.createDataFrame(rows, "id long, v array<double>, grp string")
    got = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in vectors.top_k_cosine(df.filter("id in (0, 1)"), df, "id", "v", 3, "grp").collect()}
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)
    for q in (0, 1):
        best = sorted((-cos(rows[q][1], r[1]), r[0]) for r in rows[:40] if r[0] != q and (rows[q][2] is None or r[2] != rows[q][2]))[:3]
        assert [got[q, i + 1] for i in range(3)] == [(i, -s) for s, i in best]


def test_bootstrap(spark):
    rows = [("a", float(i % 10), i) for i in range(2000)] + [("b", 1.0, 1), ("c", None, 2)]
    got = {r.g: r for r in stats.bootstrap(spark.createDataFrame(rows, "g string, v double, k int").repartition(3), "g", "v", "k").collect()}
    a, width = got["a"], 1.96 * 8.25**0.5 / 2000**0.5
    assert a.n == 2000 and a.mean == 4.5 and abs(a.ci_low - (4.5 - width)) < 0.03 and abs(a.ci_high - (4.5 + width)) < 0.03
    assert got["b"].ci_low is None and "c" not in got


def test_resamples_have_as_many_draws_as_rows(spark, monkeypatch):
    """A small table of many blocks against drawing by hand."""
    import numpy as np

    monkeypatch.setattr(stats, "BLOCK", 7)
    values = [float(x) for x in np.random.default_rng(1).normal(size=60)]
    rows = [(None, v, 100 - i) for i, v in enumerate(values)]
    got = stats.bootstrap(spark.createDataFrame(rows, "g string, v double, k int").repartition(4), "g", "v", "k", samples=50, seed=3).collect()[0]
    own, means = np.array(values[::-1]), []
    for b in range(50):
        block = stats.drawn(1, np.arange(60), b, 0, 3, 60) // 7
        picked = [own[p * 7 :][:7][stats.drawn(2, np.arange(m), b, p, 3, min(7, 60 - p * 7))] for p, m in enumerate(np.bincount(block, minlength=9).tolist())]
        assert sum(map(len, picked)) == 60
        means.append(np.concatenate(picked).mean())
    assert got.n == 60 and got.ci_low == pytest.approx(np.percentile(means, 2.5)) and got.ci_high == pytest.approx(np.percentile(means, 97.5))
    spread = np.bincount(stats.drawn(1, np.arange(1_000_000), 5, 0, 42, 100), minlength=100)
    assert abs(spread - 10_000).max() < 500 and (spread != 10_000).any()


def test_budget_policy():
    assert text.budget_policy(extra=3) == text.BUDGET | {"extra": 3}
    assert text.budget_policy(text.FACT_BUDGET, most=9000) == text.FACT_BUDGET | {"most": 9000}
    for bad in ({"other": 1}, {"enabled": 1}, {"extra": True}, {"multiplier": 0}, {"least": 9, "most": 8}, {"extra": 1.5}, {"multiplier": float("nan")}, {"multiplier": 32.5}, {"most": 32_769}, {"least": 0}, {"extra": -1}, {"retry": None}):
        with pytest.raises(ValueError):
            text.budget_policy(**bad)
    assert nested.flat_text({"a": [" x ", {"b": 1}]}) == "x\n1" and nested.flat_text([{"b": 1}], False) == "{'b': 1}"


def test_short_queries(spark):
    found = spark.createDataFrame([(1, 1, 2, 0.5), (1, 2, 3, 0.4), (2, 1, 3, 1.0000001)], "query_id int, rank int, id int, similarity double")
    assert [r.query_id for r in vectors.short_queries(found, 2, 9).collect()] == [2]
    index = spark.createDataFrame([(2, "two"), (3, "three")], "k int, name string")
    assert sorted((r.query_id, r.name, r.similarity) for r in vectors.with_documents(found, index, "k", "name").collect()) == [(1, "three", 0.4), (1, "two", 0.5), (2, "three", 1.0)]

"""Queries of evaluation runs: answers, judged stages, counters, records, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravel.functions import answers, judgements, render
from caravel.operators import evaluation, sampling
from caravel.plans.catalogue import query, rounded, table
from caravel.plans.judges import CHECK_FACTS, LIST_FACTS, FactRule, RuleJudge

OPTIONS = '["A. Copper kettle","B. Glass jar","C. Wooden spoon","D. Tin cup"]'
#: What a run answers, by p_partkey % 12: (type, reference, prediction, status, accuracy, f1).
SAID = (
    ("single_choice", "B", "Answer: B", "ok", 1.0, 1.0),
    ("single_choice", "B", "D. Tin cup", "ok", 0.0, 0.0),
    ("single_choice", '{"correct_option": "B. Glass jar", "explanation": "clear"}', "Glass jar", "ok", 1.0, 1.0),
    ("single_choice", "B", "B or D", "prediction_unparseable", 0.0, 0.0),
    ("single_choice", "B or D", "B", "invalid_reference", None, None),
    ("multiple_choice", "A, C", '{"correct_options": ["C", "A"]}', "ok", 1.0, 1.0),
    ("multiple_choice", '{"correct_options": ["A", "C"]}', "A, B and C", "ok", 0.0, 0.8),
    ("multiple_choice", "A, C", "not A and C", "prediction_unparseable", 0.0, 0.0),
    ("closed_ended", '{"text": "Yes, it holds."}', "Final answer: yes", "ok", 1.0, None),
    ("closed_ended", "No", "Yes, actually no.", "prediction_unparseable", 0.0, None),
    ("closed_ended", "No", "<think>yes</think>No.", "ok", 1.0, None),
    ("open_ended", "text", "other text", "not_objective", None, None),
)


def _said(spark, d):
    case = F.element_at(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("reference"), F.lit(p).alias("prediction")) for k, r, p, *_ in SAID]), (F.col("p_partkey") % len(SAID) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", case.alias("c")).select("p_partkey", "c.*", F.lit(OPTIONS).alias("options"))


_CASES = ", ".join(f"({i}, '{k}', '{s}', {'NULL' if a is None else a}::DOUBLE, {'NULL' if f is None else f}::DOUBLE)" for i, (k, _, _, s, a, f) in enumerate(SAID))


#: How an answer is put, in order: question type, and the text from the label said (s), its text (t), another label (o) and a name (n).
WAYS = (
    ("single_choice", "{s}"),
    ("single_choice", "Answer: {s}"),
    ("single_choice", "{s}. {t}"),
    ("single_choice", "{t}"),
    ("single_choice", "答案：{s}。"),
    ("single_choice", "The right one is {s}. {t}"),
    ("single_choice", "{s} or {o}"),
    ("single_choice", "Answer: {s}\n\nAnswer: {o}"),
    ("single_choice", "not {s}"),
    ("single_choice", '{{"correct_option": "{s}", "explanation": "{n}"}}'),
    ("single_choice", "<think>{o}</think>{s}"),
    ("single_choice", "Answer: {s} because of the {n}"),
    ("multiple_choice", "{s} and {o}"),
    ("multiple_choice", "Answer: {s}, {o}\nBoth fit."),
    ("multiple_choice", '{{"correct_options": ["{o}", "{s}"]}}'),
    ("closed_ended", "No, the {n} is not."),
)


def _filled(way: str, **parts):
    out = F.lit(way.replace("{{", "\x01").replace("}}", "\x02"))
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return F.translate(out, "\x01\x02", "{}")


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 16 AS way, p_partkey // 16 % 4 AS said, p_size % 4 AS wanted, p_brand, p_name FROM part),
k AS (SELECT *, CASE WHEN way < 12 THEN 'single_choice' WHEN way < 15 THEN 'multiple_choice' ELSE 'closed_ended' END AS kind, way IN (6, 7, 8) AS lost, (said - wanted + 4) % 4 AS off FROM p)
SELECT p_partkey, kind, CASE WHEN lost THEN 'prediction_unparseable' ELSE 'ok' END AS status,
  CASE WHEN lost THEN 0.0::DOUBLE WHEN way = 15 THEN CASE WHEN wanted % 2 = 1 THEN 1.0 ELSE 0.0 END WHEN off = 0 THEN 1.0 ELSE 0.0 END AS accuracy,
  CASE WHEN lost THEN 0.0::DOUBLE WHEN way = 15 THEN NULL WHEN off = 0 THEN 1.0 WHEN way >= 12 AND off IN (1, 3) THEN 0.5 ELSE 0.0 END AS f1,
  CASE WHEN lost OR way = 15 THEN NULL WHEN way < 12 THEN chr(CAST(65 + said AS INTEGER)) ELSE array_to_string(list_sort([chr(CAST(65 + said AS INTEGER)), chr(CAST(65 + (said + 1) % 4 AS INTEGER))]), ', ') END AS labels,
  CASE WHEN way IN (9, 15) THEN CASE WHEN way = 9 THEN p_name ELSE 'the ' || p_name || ' is not.' END ELSE '' END AS reason
FROM k
""")
def answer_parse(spark, d):
    """Answers put in many ways over options that differ from row to row."""
    k = F.col("p_partkey")
    said, wanted = F.floor(k / 16) % 4, F.col("p_size") % 4
    letter = lambda n: F.char(F.lit(65) + n)
    texts = F.array(F.concat("p_name", F.lit(" in stock")), F.concat("p_type", F.lit(" sold")), F.concat("p_brand", F.lit(" asked for")), F.concat(F.lit("none of "), "p_brand"))
    options = F.to_json(F.transform(texts, lambda t, i: F.concat(letter(i), F.lit(". "), t)))
    parts = {"s": letter(said), "o": letter((said + 1) % 4), "t": F.element_at(texts, (said + 1).cast("int")), "n": F.col("p_name")}
    way = (k % len(WAYS)).cast("int")
    prediction = F.element_at(F.array(*[_filled(w, **parts) for _, w in WAYS]), way + 1)
    kind = F.element_at(F.array(*[F.lit(t) for t, _ in WAYS]), way + 1)
    right = F.when(kind == "closed_ended", F.when(wanted % 2 == 1, "No").otherwise("Yes")).when(kind == "multiple_choice", F.concat_ws(", ", letter(wanted), letter((wanted + 1) % 4))).otherwise(letter(wanted))
    rows = table(spark, d, "part").select("p_partkey", kind.alias("kind"), options.alias("options"), right.alias("reference"), prediction.alias("prediction"))
    scored = answers.with_score(rows)
    labels = F.when((F.col("s.status") == "ok") & (F.col("kind") != "closed_ended"), F.col("s.prediction"))
    return scored.select("p_partkey", "kind", "s.status", "s.accuracy", rounded(F.col("s.f1")).alias("f1"), labels.alias("labels"), F.col("s.explanation_prediction").alias("reason"))


@query(f"SELECT p_partkey, status, accuracy FROM part JOIN (VALUES {_CASES}) c(i, kind, status, accuracy, f1) ON i = p_partkey % {len(SAID)}")
def scored_run(spark, d):
    """Samples and generations as two tables, joined and scored; evidence of other parts leaks no reserved one."""
    rows = _said(spark, d)
    samples = rows.select("p_partkey", "kind", "options", "reference")
    evidence = F.when(F.col("p_partkey") % 2 == 1, F.array(F.col("p_partkey"))).otherwise(F.array().cast("array<long>"))
    generations = rows.select("p_partkey", "prediction", evidence.alias("evidence"))
    return evaluation.scored_run(samples, generations, "p_partkey", samples.filter("p_partkey % 2 = 0").select("p_partkey")).select("p_partkey", "status", "accuracy")


@query(f"""
WITH r AS (SELECT kind, accuracy AS answer_accuracy, CASE WHEN kind IN ('single_choice', 'multiple_choice') THEN f1 END AS choice_f1, CASE p_partkey % 2 WHEN 0 THEN 'base' ELSE 'tuned' END AS run
  FROM part JOIN (VALUES {_CASES}) c(i, kind, status, accuracy, f1) ON i = (p_partkey // 2) % {len(SAID)}),
m AS (SELECT run, kind, 'answer_accuracy' AS metric, answer_accuracy AS v FROM r UNION ALL SELECT run, kind, 'choice_f1', choice_f1 FROM r),
a AS (SELECT run, kind, metric, count(v) AS n, avg(v) AS mean FROM m GROUP BY 1, 2, 3)
SELECT a.kind, a.run, a.metric, a.n, round(a.mean * 100, 2) AS percent, round((a.mean - b.mean) * 100, 2) AS delta FROM a JOIN a b ON b.run = 'base' AND a.kind = b.kind AND a.metric = b.metric
""")
def type_report(spark, d):
    case = F.element_at(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).cast("double").alias("answer_accuracy"), F.lit(f).cast("double").alias("choice_f1")) for k, _, _, _, a, f in SAID]), (F.floor(F.col("p_partkey") / 2) % len(SAID) + 1).cast("int"))
    rows = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, "base").otherwise("tuned").alias("run"), case.alias("c")).select("run", "c.*")
    rows = rows.withColumn("choice_f1", F.when(evaluation.applies("choice_f1", F.col("kind")), F.col("choice_f1")))
    return evaluation.type_report(rows, "run", "kind", ["answer_accuracy", "choice_f1"], "base")


@query("""
WITH p AS (SELECT o_orderkey, o_orderkey // 4 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n % 10 IN (7, 9) THEN NULL ELSE (n % 3) / 2.0::DOUBLE END AS score, n % 10 NOT IN (7, 9) AND n % 2 = 0 AS from_cache,
  CAST(CASE WHEN n % 10 NOT IN (7, 9) AND n % 2 = 0 THEN 0 WHEN n % 10 = 7 THEN 1 WHEN n % 10 IN (3, 9) THEN 2 ELSE 1 END AS INTEGER) AS attempts FROM p
""")
def judged_with_cache(spark, d):
    """Each distinct prompt asked once; a first run over half of them fills the cache."""
    number = F.floor(F.col("o_orderkey") / 4)
    rows = table(spark, d, "orders").select("o_orderkey", number.alias("n"), F.concat(F.lit("Judge #"), number.cast("string")).alias("prompt"))
    _, cache = evaluation.judged(rows.filter("n % 2 = 0"), "o_orderkey", "prompt", RuleJudge(), judgements.read_judgement, model="rule")
    scored, _ = evaluation.judged(rows, "o_orderkey", "prompt", RuleJudge(), judgements.read_judgement, cache, model="rule")
    return scored.select("o_orderkey", F.get_json_object("parsed", "$.correctness").cast("double").alias("score"), "from_cache", "attempts")


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS id FROM lineitem)
SELECT l_orderkey, count(*) AS facts, CASE WHEN l_orderkey % 9 <> 0 THEN count(*) FILTER (WHERE l_quantity > 20) END AS supported,
  CASE WHEN l_orderkey % 9 <> 0 THEN round(count(*) FILTER (WHERE l_quantity > 20) / count(*), 6) END AS factscore FROM f GROUP BY l_orderkey
""")
def fact_scores(spark, d):
    """Facts in batches of three with places as ids; an order of which one batch is judged in the wrong form has no score."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("x"))
    facts = rows.select("l_orderkey", F.transform("x", lambda x: x["l_quantity"].cast("string")).alias("facts"))
    batches = evaluation.claim_batches(facts, "l_orderkey", "facts", 3)
    verdicts = F.transform("claims", lambda c: F.struct(c["id"].alias("id"), F.when((F.col("l_orderkey") % 9 == 0) & (F.col("batch") == 0), F.lit("yes")).otherwise((c["claim"].cast("double") > 20).cast("string")).alias("supported"), F.lit("as said").alias("reason")))
    raw = F.regexp_replace(F.to_json(F.struct(verdicts.alias("verdicts"))), r'"supported":"(true|false)"', r'"supported":$1')
    scored = evaluation.fact_scores(batches.withColumn("raw", raw), "l_orderkey", "raw", "claims")
    return scored.select("l_orderkey", "facts", "supported", rounded(F.col("factscore")).alias("factscore"))


@query("""
WITH f AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS q FROM lineitem),
s AS (SELECT o_orderkey, count(q) AS facts, count(*) FILTER (WHERE q > 20) AS supported FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN facts = 0 THEN 'ok' WHEN o_orderkey % 10 = 9 THEN 'judge_failed' ELSE 'ok' END AS fact_status,
  CASE WHEN facts = 0 THEN 0.0::DOUBLE WHEN o_orderkey % 10 = 9 THEN NULL ELSE round(supported / facts, 6) END AS factscore,
  CASE WHEN facts = 0 THEN 'empty_answer' WHEN o_orderkey % 10 = 9 THEN 'a batch of facts wasn''t checked' ELSE supported || '/' || facts END AS fact_reason FROM s
""")
def fact_precision(spark, d):
    """Each order's lines as an answer, its facts listed and checked in batches of three."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))).alias("x"))
    said = F.array_join(F.transform("x", lambda x, i: F.concat(F.lit("line "), i.cast("string"), F.lit(" has "), x["l_quantity"].cast("int").cast("string"), F.lit("."))), " ")
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = rows.select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("question"), F.col("o_orderpriority").alias("reference"), F.coalesce(said, F.lit("")).alias("prediction"))
    scores, _ = evaluation.fact_precision(rows, "o_orderkey", "question", "reference", "prediction", FactRule(), (LIST_FACTS, CHECK_FACTS), size=3)
    return scores.select("o_orderkey", "fact_status", rounded(F.col("factscore")).alias("factscore"), "fact_reason")


@query("""
WITH n AS (SELECT count(*) AS n FROM part)
SELECT o_orderkey, CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN 'fingerprint' WHEN 2 THEN 'content' WHEN 3 THEN 'prediction' WHEN 4 THEN 'evidence_count' WHEN 5 THEN 'evidence_unknown'
  WHEN 6 THEN 'evidence_tested' WHEN 7 THEN 'evidence_repeated' WHEN 8 THEN 'evidence_changed' WHEN 9 THEN 'evidence_similarity' ELSE 'no_sample' END AS defects FROM orders
""")
def cache_defects(spark, d):
    """Orders as samples, parts as knowledge, and a cached record of each order with one of ten defects or none."""
    from caravel.operators import runs

    k, parts = F.col("o_orderkey"), table(spark, d, "part")
    n = parts.count()
    knowledge = parts.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("question"), F.col("p_type").alias("reference"), F.array("p_brand").alias("images"))
    orders = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("o"), k.cast("string")).alias("id"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("reference"), F.array(F.col("o_custkey").cast("string")).alias("images"))
    defect = k % 11
    ids = [F.concat(F.lit("p"), ((k + i) % n).cast("string")) for i in (0, 1)]
    asked = orders.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), x.alias("p")) for i, x in enumerate(ids)])).alias("x")).select("o_orderkey", "x.*")
    found = asked.join(knowledge.withColumnRenamed("id", "p"), "p")
    last = F.col("i") == 1
    changed = {"id": F.when(last & (defect == 5), "x").when(last & (defect == 6), F.concat(F.lit("o"), k.cast("string"))).otherwise(F.col("p")), "question": F.when(last & (defect == 8), "other").otherwise(F.col("question")), "similarity": F.when(last & (defect == 9), float("nan")).otherwise(0.5)}
    item = F.struct(changed["id"].alias("id"), changed["question"].alias("question"), "reference", "images", changed["similarity"].alias("similarity"))
    evidence = found.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", item.alias("e")))).alias("x")).select("o_orderkey", F.transform("x", lambda x: x["e"]).alias("x"))
    evidence = evidence.select("o_orderkey", F.when(defect == 4, F.slice("x", 1, 1)).when(defect == 7, F.array(F.get("x", F.lit(0)), F.get("x", F.lit(0)))).otherwise(F.col("x")).alias("evidence"))
    cache = orders.join(evidence, "o_orderkey").select(
        "o_orderkey",
        F.when(defect == 10, "none").otherwise(F.col("id")).alias("id"),
        F.lit("generations").alias("file"),
        k.alias("line"),
        F.when(defect == 1, "old").otherwise("now").alias("fingerprint"),
        F.when(defect == 2, "other").otherwise(F.col("question")).alias("question"),
        "reference",
        "images",
        F.when(defect != 3, "said").alias("prediction"),
        "evidence",
    )
    checked = runs.cache_defects(cache, orders.drop("o_orderkey"), knowledge, "id", "now", 2)
    return checked.select("o_orderkey", F.array_join("defects", ",").alias("defects"))


_ROWS = "SELECT o_orderkey, o_orderpriority, CASE o_orderkey % 5 WHEN 0 THEN 'prediction_unparseable' WHEN 1 THEN 'invalid_reference' ELSE 'ok' END AS status, CASE o_orderkey % 7 WHEN 0 THEN 'judge_failed' ELSE 'ok' END AS judge_status, o_orderkey % 2 = 0 AS from_cache, o_orderkey % 11 = 0 AS hit_limit, o_totalprice AS seconds, CASE o_orderkey % 3 WHEN 0 THEN 256 ELSE 1024 END AS lim FROM orders"


def _rows(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        "o_orderpriority",
        F.when(k % 5 == 0, "prediction_unparseable").when(k % 5 == 1, "invalid_reference").otherwise("ok").alias("status"),
        F.when(k % 7 == 0, "judge_failed").otherwise("ok").alias("judge_status"),
        (k % 2 == 0).alias("from_cache"),
        (k % 11 == 0).alias("hit_limit"),
        F.col("o_totalprice").alias("seconds"),
        F.when(k % 3 == 0, 256).otherwise(1024).alias("lim"),
    )


@query(f"""
SELECT count(*) AS samples, count(*) FILTER (WHERE status = 'prediction_unparseable') AS parse_failures, count(*) FILTER (WHERE status = 'invalid_reference') AS invalid_references,
  count(*) FILTER (WHERE judge_status = 'judge_failed') AS judge_failures, count(*) FILTER (WHERE judge_status = 'pending') AS judge_pending, count(*) FILTER (WHERE from_cache) AS cached,
  count(*) FILTER (WHERE hit_limit) AS truncations, round(sum(seconds) FILTER (WHERE NOT from_cache), 2) AS seconds, 'needs_review' AS state FROM ({_ROWS})
""")
def run_counters(spark, d):
    return evaluation.run_counters(_rows(spark, d)).withColumn("seconds", rounded("seconds", 2))


@query(f"SELECT CAST(lim AS INTEGER) AS lim, count(*) AS n FROM ({_ROWS}) WHERE hit_limit GROUP BY 1")
def truncation_counts(spark, d):
    return evaluation.truncations(_rows(spark, d), "lim", "hit_limit")


@query(f"""
WITH a AS (SELECT status AS k, count(*) AS n FROM ({_ROWS}) GROUP BY 1), b AS (SELECT status AS k, count(*) AS n FROM ({_ROWS}) WHERE hit_limit AND status <> 'ok' GROUP BY 1)
SELECT k AS status, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM a FULL JOIN b USING (k) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)
""")
def counter_delta(spark, d):
    rows = _rows(spark, d)
    count = lambda df: df.groupBy("status").agg(F.count("*").alias("n"))
    return evaluation.counter_delta(count(rows), count(rows.filter("hit_limit and status <> 'ok'")), "status", "n")


@query(f"""
WITH l0 AS (SELECT o_orderpriority AS g, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS pos, sha256(CAST(o_orderkey AS VARCHAR) || chr(31) || status) AS h FROM ({_ROWS})),
l1 AS (SELECT g, pos // 1024 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l0 GROUP BY 1, l0.pos // 1024),
l2 AS (SELECT g, pos // 1024 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l1 GROUP BY 1, l1.pos // 1024),
l3 AS (SELECT g, pos // 1024 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l2 GROUP BY 1, l2.pos // 1024),
l4 AS (SELECT g, pos // 1024 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l3 GROUP BY 1, l3.pos // 1024)
SELECT o_orderpriority, count(*) AS samples, round(sum(seconds), 2) AS seconds, any_value(h) AS fingerprint FROM ({_ROWS}) JOIN l4 ON g = o_orderpriority GROUP BY 1
""")
def run_records(spark, d):
    return evaluation.run_record(_rows(spark, d), "o_orderpriority", "o_orderkey", "seconds", "status").withColumn("seconds", rounded("seconds", 2))


@query(f"""
SELECT 'r' AS run, o_orderkey AS id, status, round(CASE WHEN hit_limit THEN NULL ELSE floor(seconds) / 128 END * 100, 2) AS share, hit_limit OR judge_status <> 'ok' AS needs_review,
  concat_ws('；', CASE WHEN hit_limit THEN 'cut' END, CASE WHEN judge_status <> 'ok' THEN 'judge' END) AS reasons FROM ({_ROWS})
""")
def detail_rows(spark, d):
    from caravel.operators import runs

    rows = _rows(spark, d).withColumnRenamed("o_orderkey", "id").withColumn("share", F.when(~F.col("hit_limit"), F.floor("seconds") / 128))
    reasons = runs.review_reasons({"cut": F.col("hit_limit"), "judge": F.col("judge_status") != "ok"})
    return evaluation.detail(rows, "r", ["share"], reasons).select("run", "id", "status", "share", "needs_review", "reasons")


@query("""
WITH t AS (SELECT conv_id, length(text) AS n, turn FROM conversations)
SELECT count(*) AS samples, CAST(min(n) AS INTEGER) AS least, CAST(max(n) AS INTEGER) AS most, round(avg(n), 6) AS mean, sum(greatest(n - 5, 0))::BIGINT AS supervised FROM t
""")
def token_lengths(spark, d):
    """Code points stand for tokens here; the first five are a prompt."""
    from caravel.functions import training

    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    rows = table(spark, d, "conversations").select(F.filter(ids, lambda x: x > 0).alias("x"), F.char_length("text").alias("n")).select(F.array_repeat(F.lit(1), F.col("n")).alias("ids"))
    rows = rows.withColumn("labels", training.labels(F.col("ids"), F.lit(5)))
    return evaluation.token_lengths(rows, "ids", "labels").withColumn("mean", rounded("mean"))


@query("""
WITH t AS (SELECT conv_id, turn, least(length(text), 40) AS p, length(text) AS n FROM conversations)
SELECT conv_id, turn, CAST(least(p + n, 100) AS INTEGER) AS n_ids, CAST(least(n, 100 - p) AS INTEGER) AS answer_tokens, p + n > 100 AS truncated FROM t WHERE n > 0
""")
def supervised_rows(spark, d):
    from caravel.functions import training

    n = F.char_length("text")
    row = training.supervised_row(F.array_repeat(F.lit(1), F.least(n, F.lit(40))), F.array_repeat(F.lit(2), n), 100, "cut")
    return table(spark, d, "conversations").select("conv_id", "turn", row.alias("r")).filter("r is not null").select("conv_id", "turn", F.size("r.ids").alias("n_ids"), "r.answer_tokens", "r.truncated")


@query("""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN '支持' WHEN event_type = 'error' THEN '部分支持' ELSE '不支持' END AS label, event_type IN ('click', 'view', 'error') AS valid FROM events
""")
def support_labels(spark, d):
    raw = F.when(F.col("event_type").isin("click", "view"), " 支持。\n").when(F.col("event_type") == "error", '"部分支持"').otherwise("我认为支持")
    label, valid = render.support_label(raw)
    return table(spark, d, "events").select("event_id", label.alias("label"), valid.alias("valid"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END + 1 AS n, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'reference' || chr(10) || o_orderpriority || chr(10) END || 'evidence:' || o_custkey || chr(10) || '问题：' || o_orderstatus || chr(10) || '答案：' || o_orderpriority AS said FROM orders
""")
def fact_sources(spark, d):
    reference = F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.col("o_orderpriority"))
    evidence = F.array(F.struct(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("question"), F.col("o_orderpriority").alias("reference")))
    rows = table(spark, d, "orders").select("o_orderkey", render.fact_sources(reference, evidence, "both").alias("s"))
    return rows.select("o_orderkey", F.size("s").alias("n"), F.array_join(F.transform("s", lambda s: F.concat(s["source"], F.lit("\n"), s["text"])), "\n").alias("said"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus <> 'F') AS i, l_returnflag AS label, l_linestatus = 'F' AS valid FROM lineitem)
SELECT l_orderkey, string_agg('  ' || i || '. [' || label || ']' || CASE WHEN valid THEN '' ELSE ' [unread]' END || ' line ' || l_linenumber || ' (score=0.5)', chr(10) ORDER BY i) AS said FROM c GROUP BY 1
""")
def claim_lines(spark, d):
    claim = F.struct(F.col("l_linenumber").alias("at"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("claim"), F.col("l_returnflag").alias("label"), F.lit(0.5).alias("score"), (F.col("l_linestatus") != "F").alias("unread"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(claim)).alias("c"))
    claims = F.transform("c", lambda c: c.withField("valid", ~c["unread"]))
    return rows.select("l_orderkey", render.claim_lines(claims).alias("said"))


@query("""
WITH s AS (SELECT source, doc_id, n_chars >= 400 AS ok, count(*) FILTER (WHERE n_chars >= 400) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents)
SELECT source, count(*) AS seen, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE NOT ok) AS skipped FROM s WHERE before < 5 GROUP BY source
""")
def accepted_counts(spark, d):
    return sampling.accepted_counts(table(spark, d, "documents"), "source", F.col("doc_id"), F.col("n_chars") >= 400, 5)

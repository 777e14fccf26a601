"""Queries of samples, files, judged rows and runs that the other modules have no place for."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravel.functions import answers, report, text, textmetrics, training
from caravel.operators import evaluation, sampling
from caravel.plans.catalogue import query, rounded, scratch, table
from caravel.plans.judges import CHECK_FACTS, LIST_FACTS, MEANING, Echo, Judges, listed
from caravel.sources import qa, sinks


@query("""
WITH m AS (SELECT c_custkey, c_nationkey % 4 < 2 AS ok, c_acctbal AS base, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + c_nationkey END AS tuned FROM customer)
SELECT 'tuned' AS fine, 'base' AS base, 'balance' AS metric, count(tuned) AS n, count(*) AS total, round(avg(tuned - base), 6) AS delta FROM m WHERE ok
UNION ALL SELECT 'tuned', 'base', 'always', count(tuned), count(*), round(avg(tuned - base), 6) FROM m
""")
def paired_run_deltas(spark, d):
    """Two runs over the same customers, compared by a metric that applies to some of them and one that applies to all."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 4 < 2).alias("ok"), F.col("c_acctbal").alias("base"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") + F.col("c_nationkey")).alias("tuned"))
    rows = c.select("c_custkey", "ok", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col(r).alias("balance")) for r in ("base", "tuned")])).alias("x")).select("c_custkey", "ok", "x.*").withColumn("always", F.col("balance"))
    pairs = spark.range(1).select(F.lit("tuned").alias("fine"), F.lit("base").alias("base"))
    return evaluation.paired_runs(rows, pairs, "run", "c_custkey", {"balance": F.col("ok"), "always": None}).withColumn("delta", rounded("delta"))


_SPLIT = "row_number() OVER (ORDER BY sha256('42|split|' || CAST(c_custkey AS VARCHAR)), c_custkey)"


@query(f"""
WITH c AS (SELECT c_custkey, {_SPLIT} AS k FROM customer)
SELECT 'rest' AS kind, CASE WHEN k <= 50 THEN 'test' ELSE 'train' END AS role, c_custkey FROM c
UNION ALL SELECT 'sized', CASE WHEN k <= 70 THEN 'train' ELSE 'test' END, c_custkey FROM c WHERE k <= 90
""")
def shuffled_splits(spark, d):
    customers = table(spark, d, "customer").select("c_custkey")
    named = lambda kind, pair: [x.select(F.lit(kind).alias("kind"), F.lit(role).alias("role"), "c_custkey") for role, x in zip(("train", "test"), pair, strict=True)]
    parts = named("rest", sampling.shuffled_split(customers, "c_custkey", 50)) + named("sized", sampling.shuffled_split(customers, "c_custkey", 20, 70))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _part_samples(spark, d):
    """Parts as flattened samples; every seventh has no answer, some have options."""
    k = F.col("p_partkey")
    answer = F.when(k % 7 != 0, F.col("p_type"))
    return table(spark, d, "part").select(
        F.concat_ws(":", F.lit("mira:train"), k.cast("string"), F.lit("open_ended:0")).alias("id"),
        F.lit("train").alias("split"),
        k.alias("row_index"),
        F.lit("open_ended").alias("category"),
        F.lit(0).alias("qa_index"),
        F.col("p_name").alias("question"),
        answer.alias("answer"),
        F.when(k % 3 == 0, F.concat(F.lit('["'), "p_brand", F.lit('"]'))).alias("options_json"),
        F.array_compact(F.array(F.when(answer.isNull(), "answer"))).alias("missing_fields"),
        F.lit(0).alias("ord"),
    )


@query("""
WITH s AS (SELECT p_partkey AS k, 'mira:train:' || p_partkey || ':open_ended:0' AS id, p_name || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Options: ["' || p_brand || '"]' ELSE '' END AS question, p_type FROM part)
SELECT 'kept' AS kind, id, question, p_type AS detail FROM s WHERE k % 2 = 0 AND k % 7 <> 0
UNION ALL SELECT 'left out', id, NULL, 'answer' FROM s WHERE k % 2 = 0 AND k % 7 = 0
UNION ALL SELECT 'behind', id, NULL, CAST(k AS VARCHAR) FROM s WHERE k > 150
""")
def selected_samples(spark, d):
    """Wanted samples, the incomplete ones among them left out and written down first; and the samples behind a place."""
    samples = _part_samples(spark, d)
    wanted = samples.filter("row_index % 2 = 0").select(F.col("row_index").alias("ord"), "id")
    kept, lost = qa.chosen_samples(wanted, samples, "skip")
    folder = scratch(spark, "audit")
    sinks.write_selection_audit(lost, folder, policy="skip")
    audit = spark.read.schema("split string, id string, missing_fields array<string>").json(f"{folder}/left_out")
    out = kept.select(F.lit("kept").alias("kind"), "id", "question", F.col("reference").alias("detail"))
    out = out.unionByName(audit.select(F.lit("left out").alias("kind"), "id", F.lit(None).cast("string").alias("question"), F.array_join("missing_fields", ",").alias("detail")))
    behind = qa.after(samples, 150, "open_ended", 0)
    return out.unionByName(behind.select(F.lit("behind").alias("kind"), "id", F.lit(None).cast("string").alias("question"), F.col("row_index").cast("string").alias("detail")))


@query("""
SELECT CASE WHEN c_custkey % 3 = 0 THEN 'test' ELSE 'train' END AS role, CAST(row_number() OVER (PARTITION BY c_custkey % 3 = 0 ORDER BY c_custkey) - 1 AS INTEGER) AS ord, 'mira:train:' || c_custkey || ':open_ended:0' AS id FROM customer
UNION ALL SELECT 'bare', CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER), n_name FROM nation
""")
def manifests_read(spark, d):
    """A manifest of both roles and one that is a bare list, written and read back with their order."""
    folder = scratch(spark, "manifests")
    ids = table(spark, d, "customer").select("c_custkey", F.concat_ws(":", F.lit("mira:train"), F.col("c_custkey").cast("string"), F.lit("open_ended:0")).alias("id"))
    listed = lambda df, key: df.agg(F.array_sort(F.collect_list(F.struct(key, "id"))).alias("x")).select(F.transform("x", lambda x: x["id"]).alias("ids"))
    both = listed(ids.filter("c_custkey % 3 <> 0"), "c_custkey").select(F.col("ids").alias("train_ids")).join(listed(ids.filter("c_custkey % 3 = 0"), "c_custkey").select(F.col("ids").alias("test_ids")), how="cross")
    both.select(F.to_json(F.struct("train_ids", "test_ids")).alias("value")).write.text(f"{folder}/both")
    listed(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("id")), "n_nationkey").select(F.to_json("ids").alias("value")).write.text(f"{folder}/bare")
    return qa.read_manifest(spark, f"{folder}/both", required=("train", "test")).unionByName(qa.read_manifest(spark, f"{folder}/bare", role="bare"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS ord, n_name AS keyword FROM nation")
def keyword_file(spark, d):
    """Names of nations as a keyword file with comments, blank lines, repeats in other case and free white space."""
    folder = scratch(spark, "keywords")
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.concat(F.lit("  "), F.replace("n_name", F.lit(" "), F.lit("\t "))), F.lit(""), F.concat(F.lit("# "), "n_name"), F.lower("n_name"))).alias("value"))
    rows.coalesce(1).sortWithinPartitions("n_nationkey", F.when(F.col("value").startswith("  "), 0).otherwise(1)).select("value").write.text(folder)
    return spark.createDataFrame(list(enumerate(qa.read_keywords(spark, folder))), "ord int, keyword string")


@query("""
SELECT 'predictions' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'review', count(*) FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'type ' || o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'lines', count(*) + count(*) FILTER (WHERE o_orderkey % 2 = 0) FROM orders UNION ALL SELECT 'summary', count(*) FROM orders WHERE o_orderkey % 7 = 0
""")
def written_results(spark, d):
    """Scored rows in all, by type and for review, rows as text, and a summary with given facts, all read back."""
    folder = scratch(spark, "results")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    sinks.write_scored(rows, f"{folder}/scored", "o_orderstatus", F.col("o_orderkey") % 7 == 0)
    sinks.write_text(rows.withColumn("note", F.when(F.col("o_orderkey") % 2 == 0, "even")), f"{folder}/text", "o_orderpriority", "note")
    sinks.write_summary(rows.agg(F.count_if(F.col("o_orderkey") % 7 == 0).alias("review")), f"{folder}/summary", seed=42)
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    types = spark.read.json(f"{folder}/scored/by_type").groupBy(F.concat(F.lit("type "), "_kind").alias("kind")).agg(F.count("*").alias("n"))
    lines = spark.read.text(f"{folder}/text").filter("value <> ''")
    summary = spark.read.schema("review long, seed int").json(f"{folder}/summary").filter("seed = 42").select(F.lit("summary").alias("kind"), F.col("review").alias("n"))
    out = count(spark.read.json(f"{folder}/scored/predictions"), "predictions").unionByName(count(spark.read.json(f"{folder}/scored/review_needed"), "review"))
    return out.unionByName(types).unionByName(count(lines, "lines")).unionByName(summary)


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS context FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) GROUP BY l_orderkey")
def contexts(spark, d):
    """Each order's lines as evidence, assembled in the order of ranks."""
    from caravel.operators.ordering import running

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat("l_returnflag", "l_linestatus").alias("text"))
    ranked = running(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], into="rank")
    return sinks.context_blocks(ranked, "l_orderkey", "rank", "text", 200_000)


@query("""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE trim(coalesce(text, '')) <> ''),
l AS (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last FROM t GROUP BY conv_id),
c AS (SELECT conv_id, count(*) AS rows_ FROM conversations GROUP BY conv_id)
SELECT c.conv_id, CAST(CASE WHEN last = 'assistant' THEN n ELSE 2 END AS INTEGER) AS n, CASE WHEN last = 'assistant' THEN 'as said' ELSE 'built' END AS kind, CAST(CASE WHEN last = 'assistant' THEN n ELSE 2 END AS VARCHAR) || ',' || repeat('0,', CAST(40 - CASE WHEN last = 'assistant' THEN n ELSE 2 END AS INTEGER)) AS padded
FROM c LEFT JOIN l USING (conv_id)
""")
def repaired_chats(spark, d):
    """Messages that must end with an answer, else built from a question and an answer; and a row padded to a length."""
    from caravel.operators import corpus

    chats = corpus.collected_turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    made = chats.select("conv_id", training.answered(F.col("messages"), F.lit("q"), F.lit("a")).alias("m"))
    n = F.size("m")
    built = F.when((n == 2) & (F.get("m", F.lit(0))["content"] == "q"), "built").otherwise("as said")
    padded = training.padded(F.array(n), F.lit(41) - n, 0)
    return made.select("conv_id", n.alias("n"), built.alias("kind"), F.concat(F.array_join(padded, ","), F.lit(",")).alias("padded"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN '' END AS aliased, CASE WHEN length(event_type) > 8 THEN substr(event_type, 1, 4) || '...' || substr(event_type, length(event_type) - 3) ELSE '<set>' END AS secret,
  CAST(user_id AS VARCHAR) || ' x' AS cleaned, event_type || CASE WHEN event_id % 2 = 0 THEN '!' ELSE '.' END AS instruction,
  event_type || 'mri2' AS bare, CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS similar FROM events
""")
def tidy_fields(spark, d):
    """Aliases of a field in order, masked secrets, texts cleaned for comparison, instructions that end with a mark, bare texts and their similarity."""
    kind = F.col("event_id") % 3
    doc = F.when(kind == 0, F.concat(F.lit('{"content": "'), "event_type", F.lit('", "text": "other"}'))).when(kind == 1, F.concat(F.lit('{"value": "", "text": "'), "event_type", F.lit('"}'))).otherwise("{}")
    wide = F.translate(F.col("user_id").cast("string"), "0123456789", "０１２３４５６７８９")
    end = F.when(F.col("event_id") % 2 == 0, "!").otherwise(" ")
    bare = textmetrics.bare_text(F.concat(F.lit("<think>x</think> "), F.upper("event_type"), F.lit("; MRI_2! \n")))
    return table(spark, d, "events").select(
        "event_id",
        report.field(F.parse_json(doc), "content", "value", "text").alias("aliased"),
        text.masked_key(F.col("event_type")).alias("secret"),
        answers.clean(F.concat(F.lit(" "), wide, F.lit(" \t Ｘ。 "))).alias("cleaned"),
        training.closed_instruction(F.concat("event_type", end)).alias("instruction"),
        bare.alias("bare"),
        textmetrics.similarity(bare, F.when(F.col("event_id") % 2 == 0, bare).otherwise("")).alias("similar"),
    )


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_name, p_type, p_brand FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN p_name || chr(10) || p_type WHEN 1 THEN 'Answer: ' || p_name || chr(10) || 'Explanation: ' || p_type || '.' WHEN 2 THEN '' WHEN 3 THEN p_name WHEN 4 THEN p_name || chr(10) || p_type || ', ' || p_brand ELSE 'Yes' || chr(10) || '5' END AS semantic,
  CASE k WHEN 0 THEN p_type WHEN 1 THEN p_type || '.' WHEN 4 THEN p_type || chr(10) || p_brand ELSE '' END AS reason,
  CASE WHEN k IN (2, 5) THEN 'prediction_unparseable' WHEN k = 3 THEN 'prediction_missing' ELSE 'ok' END AS explanation_status,
  CASE k WHEN 2 THEN 'prediction_unparseable' ELSE 'not_objective' END AS status, CASE k WHEN 0 THEN p_name WHEN 1 THEN 'Answer: ' || p_name || chr(10) || 'Explanation: ' || p_type || '.' WHEN 2 THEN '' WHEN 3 THEN p_name WHEN 4 THEN p_name ELSE 'Yes' END AS plain, p_brand AS wanted FROM p
""")
def explained_answers(spark, d):
    """What open answers say, and the reasons they give, from fields, sections and lists."""
    k = F.col("p_partkey") % 6
    parts = {"n": F.col("p_name"), "t": F.col("p_type"), "b": F.col("p_brand")}
    ways = ('{"text": "[n]", "explanation": "[t]"}', "Answer: [n]\nExplanation: [t].", "<think>[n]", "[n]", '{"answer": {"text": "[n]", "rationale": ["[t]", "[b]"]}}', '{"text": true, "reasoning": 5}')
    made = []
    for way in ways:
        c = F.lit(way)
        for name, value in parts.items():
            c = F.replace(c, F.lit(f"[{name}]"), value)
        made.append(c)
    rows = table(spark, d, "part").select("p_partkey", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("options"), F.concat(F.lit('{"explanation": "'), "p_brand", F.lit('"}')).alias("reference"), F.element_at(F.array(*made), (k + 1).cast("int")).alias("prediction"))
    s = answers.with_score(rows)
    return s.select("p_partkey", F.col("s.semantic_prediction").alias("semantic"), F.col("s.explanation_prediction").alias("reason"), "s.explanation_status", "s.status", F.col("s.prediction").alias("plain"), F.col("s.explanation_reference").alias("wanted"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)
SELECT o_orderkey, CAST(CASE WHEN k IN (0, 1) THEN 2 WHEN k = 4 THEN 1 END AS INTEGER) AS n, k IN (0, 1, 4) AS readable FROM o
""")
def strict_lists(spark, d):
    """Answers that list facts or claims: whole, fenced, with a fact repeated, with more text, claims repeated, and claims that are no texts."""
    k = F.col("o_orderkey") % 6
    named = F.col("o_orderpriority")
    facts = lambda *x: F.concat(F.lit('{"facts": ["'), F.concat_ws('", "', *x), F.lit('"]}'))
    raw = F.when(k == 0, facts(named, F.lit("b"))).when(k == 1, F.concat(F.lit("```json\n"), facts(named, F.lit(" b ")), F.lit("\n```"))).when(k == 2, facts(named, F.concat(F.lower(named), F.lit(" ")))).when(k == 3, F.concat(F.lit("Here: "), facts(named)))
    raw = raw.when(k == 4, F.concat(F.lit('["'), named, F.lit('", " '), named, F.lit('"]'))).otherwise(F.concat(F.lit('["'), named, F.lit('", 3]')))
    rows = table(spark, d, "orders").select("o_orderkey", raw.alias("prompt"), F.when(k < 4, "facts").otherwise("claims").alias("form"))
    scored, _ = evaluation.judged(rows, "o_orderkey", "prompt", Echo(), listed, context="form", retries=0)
    return scored.select("o_orderkey", F.size(F.from_json("parsed", "array<string>")).alias("n"), F.col("error").isNull().alias("readable")).withColumn("n", F.when(F.col("readable"), F.col("n")))


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS f, o_orderkey % 2 = 0 AS s, o_orderkey % 4 = 0 AS done, o_orderpriority FROM orders)
SELECT o_orderkey, CASE WHEN f THEN CASE WHEN o_orderkey % 9 > 4 THEN 0.5 ELSE 0.0 END END::DOUBLE AS factscore, CASE WHEN f THEN 'ok' ELSE 'not_required' END AS fact_status,
  CASE WHEN s THEN CASE WHEN done THEN 0.25 WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 2 = 0 THEN 1.0 ELSE 0.5 END END::DOUBLE AS semantic, CASE WHEN s THEN 'ok' ELSE 'not_required' END AS semantic_status FROM o
""")
def pending_judged(spark, d):
    """Orders of which some need their facts checked, some their meaning, and some have that already."""
    k = F.col("o_orderkey")
    done = (k % 4 == 0) & (k % 2 == 0)
    said = F.concat(F.lit("it has "), F.when(k % 9 > 4, "30").otherwise("3"), F.lit(". and 7."))
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("q").alias("question"), F.col("o_orderpriority").alias("reference"), said.alias("prediction"), (k % 3 == 0).alias("fact_required"), (k % 2 == 0).alias("semantic_required"), F.lit(None).cast("double").alias("factscore"), F.lit("pending").alias("fact_status"), F.when(done, 0.25).alias("semantic"), F.when(done, "ok").alias("semantic_status"))
    out, _ = evaluation.judge_pending(rows, "o_orderkey", Judges(), (LIST_FACTS, CHECK_FACTS, MEANING))
    return out.select("o_orderkey", "factscore", "fact_status", "semantic", "semantic_status")


@query("""
WITH c AS (SELECT CASE c_nationkey % 4 WHEN 0 THEN 'open_ended' WHEN 1 THEN 'closed_ended' WHEN 2 THEN 'single_choice' ELSE 'multiple_choice' END AS category, count(*) AS n FROM customer GROUP BY 1)
SELECT category, n AS counted, round(n / sum(n) OVER (), 6) AS ratio FROM c
""")
def type_shares(spark, d):
    """Counts of the four types as checked settings, and as ratios of one."""
    kind = F.element_at(F.array(*[F.lit(t) for t in sampling.TYPES]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    counts = sampling.type_counts({r["k"]: r["count"] for r in table(spark, d, "customer").groupBy(kind.alias("k")).count().collect()})
    ratios = sampling.type_ratios(counts)
    return spark.createDataFrame([(t, counts[t], round(ratios[t], 6)) for t in sampling.TYPES], "category string, counted long, ratio double")


@query("""
SELECT p_partkey, k IN ('single_choice', 'multiple_choice', 'closed_ended') AS answer_accuracy, k IN ('single_choice', 'multiple_choice') AS choice_f1, p_size % 2 = 0 AS factscore, true AS bleu
FROM (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 'open_ended' WHEN 1 THEN 'closed_ended' WHEN 2 THEN 'single_choice' ELSE 'multiple_choice' END AS k FROM part)
""")
def metric_flags(spark, d):
    """Which metrics count for a row: by its type, by its own flag, or always."""
    kind = F.element_at(F.array(*[F.lit(t) for t in sampling.TYPES]), (F.col("p_partkey") % 4 + 1).cast("int"))
    flag = {"factscore": F.col("p_size") % 2 == 0}
    return table(spark, d, "part").select("p_partkey", *[evaluation.applies(m, kind, flag).alias(m) for m in ("answer_accuracy", "choice_f1", "factscore", "bleu")])


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def opened_index(spark, d):
    """Vectors ingested under a configuration and opened under the same, every setting and every vector's size checked."""
    from caravel.streaming.ingest import ingest, open_index

    folder = scratch(spark, "vectors")
    source = table(spark, d, "embeddings")
    config = {"model": {"name": "given", "weights": []}, "pooling": "none", "instruction": "", "space": "cosine"}
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/embeddings.parquet*")
    ingest(stream, "vec_id", f"{folder}/stored", f"{folder}/progress", order="vec_id", config=config, buckets=16).awaitTermination()
    return open_index(spark, f"{folder}/stored", config, 64, "embedding").groupBy("label").agg(F.count("*").alias("n"))

"""Queries of question-answer corpora: sources read from files, samples as text, the sampling run, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from caravel.functions import nested, render, report, text, training
from caravel.operators import corpus, index, keywords, ordering, sampling, vectors
from caravel.plans.catalogue import query, scratch, table
from caravel.sources import qa, samples, sinks

_LOT = "sha256('42|{salt}|' || CAST(c_custkey AS VARCHAR))"
_KIND = "CASE c_nationkey % 4 WHEN 0 THEN 'open_ended' WHEN 1 THEN 'closed_ended' WHEN 2 THEN 'single_choice' ELSE 'multiple_choice' END"


def _kind(key: str):
    return F.element_at(F.array(*[F.lit(t) for t in sampling.TYPES]), (F.col(key) % 4 + 1).cast("int"))


def _customers(spark, d):
    """Customers as samples: a type, whether an index has them (they have an order), a keyword (balance above 5000), and shared groups."""
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", _kind("c_nationkey").alias("category"), F.array((F.col("c_custkey") % 500).cast("string")).alias("images"))
    return sampling.tagged(rows, "c_custkey", table(spark, d, "orders"), "o_custkey", F.col("c_acctbal") > 5000)


_TAGGED = f"""
SELECT c_custkey, {_KIND} AS category, c_custkey % 500 AS image, c_custkey IN (SELECT o_custkey FROM orders) AS embedded, c_acctbal > 5000 AS keyword,
  CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN CASE WHEN c_acctbal > 5000 THEN 0 ELSE 1 END WHEN c_acctbal > 5000 THEN 2 ELSE 3 END AS tier FROM customer"""
_ROLES = f"""
WITH t AS ({_TAGGED}),
test AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY tier, {_LOT.format(salt='test')}, c_custkey) AS k FROM t) WHERE k <= 2),
rest AS (SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM test) AND image NOT IN (SELECT image FROM test)),
train AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY tier, {_LOT.format(salt='train')}, c_custkey) AS k FROM rest) WHERE k <= 3),
roles AS (SELECT c_custkey, category, tier, embedded, keyword, 'test' AS role FROM test UNION ALL SELECT c_custkey, category, tier, embedded, keyword, 'train' FROM train)"""
_COUNTS = "count(*) AS total, count(*) FILTER (WHERE embedded) AS embedded, count(*) FILTER (WHERE NOT embedded) AS missing, count(*) FILTER (WHERE keyword) AS keyword, count(*) FILTER (WHERE embedded AND keyword) AS both, " + ", ".join(f"count(*) FILTER (WHERE category = '{t}') AS {t}" for t in sampling.TYPES)


def _roles(spark, d):
    return sampling.sample_roles(_customers(spark, d), "c_custkey", "category", dict.fromkeys(sampling.TYPES, 2), dict.fromkeys(sampling.TYPES, 3), 42, "images")


@query(_ROLES + " SELECT c_custkey, category, CAST(tier AS INTEGER) AS tier, embedded, keyword, role FROM roles")
def sample_roles(spark, d):
    return _roles(spark, d)


@query(_ROLES + f" SELECT role, {_COUNTS} FROM roles GROUP BY role")
def selected_role_counts(spark, d):
    return sampling.tag_counts(_roles(spark, d), "role", "category")


@query(f"SELECT category AS kind, {_COUNTS.replace('count(*) AS total', 'count(*) AS total')} FROM ({_TAGGED}) GROUP BY category")
def population_audit(spark, d):
    return sampling.tag_counts(_customers(spark, d).withColumn("kind", F.col("category")), "kind", "category")


@query(f"""
WITH t AS ({_TAGGED}), r AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0),
test AS (SELECT c_custkey, image FROM t WHERE c_custkey IN (SELECT c_custkey FROM r) AND category <> 'open_ended' ORDER BY c_custkey LIMIT 10),
rest AS (SELECT c_custkey FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM r) AND image NOT IN (SELECT image FROM test) ORDER BY {_LOT.format(salt='knowledge')}, c_custkey LIMIT 40)
SELECT 'test' AS role, c_custkey FROM test UNION ALL SELECT 'knowledge', c_custkey FROM rest
""")
def evaluation_split(spark, d):
    rows = _customers(spark, d)
    reserved = rows.filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("ord"), "c_custkey")
    test, rest = sampling.evaluation_split(rows, "c_custkey", reserved, 10, 40, 42, "images", list(sampling.TYPES[1:]))
    return test.select(F.lit("test").alias("role"), "c_custkey").unionByName(rest.select(F.lit("knowledge").alias("role"), "c_custkey"))


@query("""
SELECT 'look' AS kind, c_custkey FROM (SELECT c_custkey FROM customer ORDER BY sha256('42|look|' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 20)
UNION ALL SELECT 'one', c_custkey FROM (SELECT c_custkey FROM customer ORDER BY length(c_name) > 3, sha256('7|one|' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 1)
UNION ALL SELECT 'at', c_custkey FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 5)
""")
def seeded_looks(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    parts = {"look": sampling.seeded_rows(rows, "c_custkey", 20, 42), "one": sampling.one_example(rows, "c_custkey", "c_name", 3, 7), "at": sampling.one_example(rows, "c_custkey", "c_name", 3, index=5)}
    out = [df.select(F.lit(n).alias("kind"), "c_custkey") for n, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# samples as text


def _samples(spark, d):
    """Parts as samples with gaps: no question, no answer, no options, no caption."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        "p_partkey",
        F.when(k % 5 != 0, F.col("p_name")).alias("question"),
        F.when(k % 7 == 0, "{}").when(k % 7 == 1, F.lit(None)).otherwise(F.col("p_type")).alias("answer"),
        F.when(k % 3 == 0, F.concat(F.lit('["'), F.col("p_brand"), F.lit('"]'))).alias("options"),
        F.when(k % 2 == 0, F.col("p_brand")).alias("caption"),
    )


_SAMPLES = """SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name ELSE '[not provided in source]' END || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Options: ["' || p_brand || '"]' ELSE '' END AS q,
  CASE WHEN p_partkey % 7 < 2 THEN '[not provided in source]' ELSE p_type END AS a, CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Caption: ' || p_brand ELSE '' END AS c FROM part"""


@query(f"SELECT p_partkey, 'Question: ' || q || chr(10) || 'Answer: ' || a || c AS document, 'Question: ' || q || chr(10) || 'Answer: [not provided in source]' AS asked FROM ({_SAMPLES})")
def sample_documents(spark, d):
    rows = _samples(spark, d)
    asked = render.query_document(render.question_text(F.col("question"), F.col("options")))
    return rows.select("p_partkey", render.sample_document(F.col("question"), F.col("answer"), F.col("options"), caption=F.col("caption")).alias("document"), asked.alias("asked"))


@query("SELECT doc_id, source || ':' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS key, source || '.csv' AS source_csv, CAST(1 AS INTEGER) AS image_count, '[\"' || lang || '.png\"]' AS image_paths, n_chars > 0 AS has_question, false AS has_answer FROM documents")
def provenance_rows(spark, d):
    made = render.provenance(F.col("source"), F.col("doc_id"), F.lit("open_ended"), F.lit(0), F.array(F.concat("lang", F.lit(".png"))), F.lit(""), F.array_compact(F.array(F.when(F.col("n_chars") <= 0, "question"), F.lit("answer"))))
    placed = ordering.running(table(spark, d, "documents").drop("text"), ["source"], ["doc_id"], into="place")
    rows = placed.select("doc_id", render.row_key(F.col("source"), F.col("place") + 1).alias("key"), made.alias("p"))
    return rows.select("doc_id", "key", *[f"p.{c}" for c in ("source_csv", "image_count", "image_paths", "has_question", "has_answer")])


@query("SELECT event_id, json_extract_string(props, '$.k') AS key, 'lines' || chr(10) || json_extract_string(props, '$.k') AS listed, '{\"event_id\":' || event_id || ',\"nothing\":null}' AS compact, CASE WHEN length(props) > 4 THEN props[1:4] || chr(10) || '... [' || (length(props) - 4) || ' characters left out]' ELSE props END AS short, CAST(length(props) AS INTEGER) AS n FROM events")
def rendered_fields(spark, d):
    v = F.parse_json("props")
    listed = F.parse_json(F.concat(F.lit('["lines",'), F.get_json_object("props", "$.k"), F.lit("]")))
    rows = table(spark, d, "events")
    return rows.select("event_id", render.canonical_key(F.try_variant_get(v, "$.k", "variant")).alias("key"), render.lines_of(listed).alias("listed"), render.compact_json(F.col("event_id"), F.lit(None).cast("string").alias("nothing")).alias("compact"), render.shortened(F.col("props"), 4).alias("short"), render.text_lengths(props=F.col("props"))["props"].alias("n"))


@query("""
WITH k AS (SELECT 'mira:train:' || c_custkey || ':open_ended:' || (c_custkey % 5) AS id,
  CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'mira:' ELSE 'x-mira:' END || 'train:' || c_custkey || ':open_ended:' || (c_custkey % 5 + CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE 1 END) AS stored FROM customer),
f AS (SELECT 'as_is' AS form, id AS k FROM k UNION ALL SELECT 'prefix', 'x-' || id FROM k UNION ALL SELECT 'bare', substr(id, 6) FROM k
  UNION ALL SELECT form, lead || regexp_extract(id, '^(.*):([0-9]+)$', 1) || ':' || (CAST(regexp_extract(id, '^(.*):([0-9]+)$', 2) AS BIGINT) + step) FROM k, (VALUES ('prefix_previous', 'x-', -1), ('previous', '', -1), ('prefix_next', 'x-', 1), ('next', '', 1)) s(form, lead, step))
SELECT form, count(s.stored) AS hits, count(*) AS asked FROM f LEFT JOIN (SELECT DISTINCT stored FROM k) s ON s.stored = f.k GROUP BY form
""")
def id_forms(spark, d):
    key = lambda n: F.concat_ws(":", F.lit("train"), F.col("c_custkey").cast("string"), F.lit("open_ended"), n.cast("string"))
    last = F.col("c_custkey") % 5
    lead = F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 7 == 1, "mira:").otherwise("x-mira:")
    rows = table(spark, d, "customer").select(F.concat(F.lit("mira:"), key(last)).alias("id"), F.concat(lead, key(last + F.when(F.col("c_custkey") % 3 == 0, -1).otherwise(1))).alias("stored"))
    return vectors.best_key_form(rows, "id", text.key_forms(F.col("id"), "x-"), rows, "stored")


# sources: tables written as files and read back


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS question, p_type AS reference, CAST(1 AS INTEGER) AS n_images, CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS line FROM part")
def json_lines_strict(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("question"), F.col("p_type").alias("reference"), F.array(F.col("p_brand")).alias("images"), F.col("p_size").alias("extra"))
    path = scratch(spark, "lines")
    sinks.write_json_lines(rows.coalesce(1).sortWithinPartitions(F.col("id").cast("long")), path)
    read = qa.read_eval_samples(spark, path).select("id", "question", "reference", F.size("images").alias("n_images"))
    lines = qa.read_json_lines(spark, path, ["id"]).select("line", F.variant_get("value", "$.id", "string").alias("id"))
    return read.join(lines, "id")


@query("""
SELECT CASE WHEN p_partkey % 6 = 0 THEN 'invalid' WHEN p_partkey % 6 = 1 THEN 'missing_question' WHEN p_partkey % 6 = 2 THEN 'missing_answer' WHEN p_partkey % 6 = 3 THEN 'url_only' ELSE 'usable' END AS kind, count(*) AS n FROM part GROUP BY 1
""")
def json_line_classes(spark, d):
    """Lines of a corpus, some of them broken, by class."""
    k = F.col("p_partkey") % 6
    line = F.when(k == 0, '{"question": ').when(k == 1, '{"question": " ", "answer": "a"}').when(k == 2, '{"question": "q"}').when(k == 3, '{"question": "q", "answer": "https://x.org/a"}').otherwise('{"question": "q", "answer": "a"}')
    path = scratch(spark, "classes")
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    v = F.try_parse_json("value")
    get = lambda n: F.try_variant_get(v, f"$.{n}", "string")
    rows = spark.read.text(path).select(F.when(v.isNull(), "invalid").otherwise(corpus.pair_class(get("question"), get("answer"))).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_name, p_type, p_brand FROM part)
SELECT 'mira:train:' || i || ':open_ended:0' AS id, p_name AS question, CASE WHEN p_partkey % 4 = 0 THEN 'answer' ELSE '' END AS missing, '/data/' || p_brand || '.png' AS image FROM r
UNION ALL SELECT 'mira:train:' || i || ':single_choice:0', p_type || chr(10) || 'x', '', '/data/' || p_brand || '.png' FROM r WHERE p_partkey % 3 = 0
""")
def image_rows_flatten(spark, d):
    """Parts as rows of a CSV with nested JSON, read back and flattened; image paths are cleaned and placed."""
    k = F.col("p_partkey")
    one = lambda q, a: F.array(F.struct(q.alias("question"), a.alias("answer")))
    cell = F.to_json(F.struct(one(F.col("p_name"), F.when(k % 4 != 0, F.col("p_type"))).alias("open_ended"), F.when(k % 3 == 0, one(F.concat("p_type", F.lit("\nx")), F.lit("A"))).otherwise(F.array().cast("array<struct<question:string,answer:string>>")).alias("single_choice")))
    path = scratch(spark, "images")
    rows = table(spark, d, "part").select(k, F.concat(F.lit("a/b/../../"), "p_brand", F.lit(".png")).alias("image_path"), F.lit("").alias("caption"), cell.alias("vqa_json"))
    rows.coalesce(1).sortWithinPartitions("p_partkey").drop("p_partkey").write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    made = qa.flatten(qa.read_image_rows(spark, path, "train"))
    return made.select("id", "question", F.array_join("missing_fields", ",").alias("missing"), qa.placed(F.element_at(qa.image_keys(F.col("images")), 1), "/data").alias("image"))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS role, CAST(o_orderkey AS VARCHAR) AS id FROM orders")
def manifest_rows(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    path = scratch(spark, "manifest")
    number = F.col("id").cast("long")
    sinks.write_manifest(ids.filter(number % 3 != 0), ids.filter(number % 3 == 0), "id", path)
    return spark.read.schema("role string, id string").json(path)


@query("SELECT page_id, sha256(html) AS sha FROM pages")
def chunks_written_and_read(spark, d):
    path = scratch(spark, "chunks")
    sinks.chunk_rows(table(spark, d, "pages"), "page_id", "html", 1000).write.parquet(path)
    return sinks.restored(spark.read.parquet(path), "page_id").select("page_id", F.sha2("text", 256).alias("sha"))


@query("SELECT 'id-' || c_custkey AS id FROM customer WHERE c_nationkey = 3")
def indexed_ids(spark, d):
    """An index's metadata as relations: collections are nations, segments hold customers' ids."""
    nations = table(spark, d, "nation")
    collections = nations.select(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("main").alias("database"), F.col("n_name").alias("name"))
    segments = nations.select(F.explode(F.array(*[F.struct(F.concat(F.lit(s[0]), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("collection"), F.lit(s).alias("scope")) for s in ("METADATA", "VECTOR")])).alias("x")).select("x.*")
    metadata = table(spark, d, "customer").select(F.concat(F.lit("M"), F.col("c_nationkey").cast("string")).alias("segment"), F.concat(F.lit("id-"), F.col("c_custkey").cast("string")).alias("embedding_id"))
    name = nations.filter("n_nationkey = 3").first()["n_name"]
    return qa.indexed_ids(collections, segments, metadata, "main", name)


# layouts and reports


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'system: s' || chr(10) || 'user: ' || event_type || chr(10) || 'assistant: a' WHEN 1 THEN 'system: s' || chr(10) || 'user: ' || event_type || chr(10) || chr(10) || props || chr(10) || 'assistant: b'
  WHEN 2 THEN 'system: s' || chr(10) || 'user: ' || event_type || chr(10) || 'assistant: <think>' || chr(10) || props || chr(10) || '</think>' || chr(10) || 'c' END AS said FROM events
""")
def layouts_by_hint(spark, d):
    e, p = F.col("event_type"), F.col("props")
    layouts = {"pair": training.three_messages("s", e, F.lit("a")), "instruction": training.from_instruction("s", e, p, F.lit("b")), "reasoned": training.from_reasoned("s", e, p, F.lit("c"), True)}
    hint = F.element_at(F.array(*[F.lit(x) for x in ("auto", "instruction", "reasoned", "unknown")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", training.rendered(training.by_hint(hint, layouts)).alias("said"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN '心血管相关症状或危险因素待评估。' ELSE '疑似冠心病或冠状动脉粥样硬化相关风险，需进一步临床评估。' END AS diagnosis,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_brand || chr(10) || 'x' WHEN 2 THEN '患者信息：年龄 ' || p_size || '；' || p_brand || chr(10) || '症状：' || p_type || chr(10) || '检查：' || p_name
  ELSE '患者信息：年龄 ' || p_size || '；' || p_brand || chr(10) || '症状：胸痛' || chr(10) || '症状：气短' || chr(10) || '检查：' || p_name END AS findings FROM part
""")
def report_cascade(spark, d):
    """Answers in JSON, under headings, or neither: then a summary by rule."""
    k = F.col("p_partkey") % 4
    answer = F.when(k == 0, F.concat(F.lit('so {"result": {"diagnosis": "'), "p_name", F.lit('"}} ok'))).when(k == 1, F.concat(F.lit("诊断结果："), "p_type", F.lit("\n关键发现："), "p_brand", F.lit("\nx\n临床建议：y"))).otherwise("nothing of the kind")
    symptoms = F.when(k == 3, "胸痛；气短").otherwise(F.col("p_type"))
    diagnosis, findings = report.summary_by_rule({"年龄": F.col("p_size").cast("string"), "": F.col("p_brand")}, symptoms, F.col("p_name"), F.lit(None).cast("string"))
    made = report.report_of(answer, {"diagnosis": diagnosis, "findings": findings})
    return table(spark, d, "part").select("p_partkey", made.alias("r")).select("p_partkey", "r.diagnosis", "r.findings")


@query("SELECT event_id, CAST(3 AS INTEGER) AS n, event_type AS diagnosis, CASE WHEN event_id % 2 = 0 THEN 'late' ELSE 'f' END AS findings FROM events")
def stream_folded(spark, d):
    """A server's event stream: distinct payloads, folded so that the last text of a field stays."""
    stream = F.concat(F.lit('data: {"diagnosis": "x", "findings": "f"}\n\ndata: {"delta": {"diagnosis": "'), "event_type", F.lit('"}}\r\ndata: [DONE]\n: note {"findings": "'), F.when(F.col("event_id") % 2 == 0, "late").otherwise(" "), F.lit('"}\ndata: {"diagnosis": "x", "findings": "f"}'))
    rows = table(spark, d, "events").select("event_id", report.events_of(stream).alias("p"))
    return rows.select("event_id", F.size("p").alias("n"), report.folded(F.col("p")).alias("r")).select("event_id", "n", "r.diagnosis", "r.findings")


# vectors with what they stand for


@query("""
SELECT vec_id, CAST(p - 1 AS INTEGER) AS position, round((CAST(embedding[p] AS DOUBLE) + embedding[p + 16] + CASE WHEN label % 2 = 0 THEN CAST(embedding[p + 48] AS DOUBLE) ELSE 0 END) / CASE WHEN label % 2 = 0 THEN 3 ELSE 2 END, 6) AS value
FROM (SELECT *, unnest(range(1, 17)) AS p FROM embeddings)
""")
def masked_means(spark, d):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))
    mask = F.array(F.lit(1), F.lit(1), F.lit(0), F.when(F.col("label") % 2 == 0, 1).otherwise(0))
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.masked_mean(tokens, mask)).alias("position", "value"))
    return rows.withColumn("value", F.round("value", 6))


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS l FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, round(list_inner_product(q.e, c.e) / (q.l * c.l), 6) AS similarity FROM n q JOIN n c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, label, greatest(-1, least(1, similarity)) AS similarity FROM r WHERE rank <= 3
""")
def retrieved_documents(spark, d):
    """Hits with the label of what was found; every query has as many as asked for."""
    e = table(spark, d, "embeddings")
    found = vectors.top_k_cosine(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 3)
    return vectors.with_documents(found, e, "vec_id", "label").select("query_id", "rank", "id", "label", "similarity")


@query("SELECT sum(n)::BIGINT AS questions FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) WHERE lang IN ('en', 'de')")
def question_total(spark, d):
    """The sum of a manifest's counts for chosen splits."""
    manifest = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return manifest.filter(F.col("lang").isin("en", "de")).agg(F.sum("n").alias("questions"))


@query("""
SELECT o_orderkey, 'p: ' || o_orderpriority || chr(10) || o_orderstatus AS flat, o_orderpriority || chr(10) || o_orderstatus AS leaves FROM orders
""")
def nested_texts(spark, d):
    doc = F.to_json(F.struct(F.concat(F.lit(" p: "), "o_orderpriority").alias("a"), F.array(F.lit(" "), F.col("o_orderstatus")).alias("b")))
    other = F.to_json(F.struct(F.col("o_orderpriority").alias("a"), F.array(F.struct(F.col("o_orderstatus").alias("x"), F.lit(3).alias("y"))).alias("b")))
    return table(spark, d, "orders").select("o_orderkey", nested.json_flat(doc).alias("flat"), F.array_join(nested.json_leaves(other), "\n").alias("leaves"))


@query("""
SELECT event_id, '{"a":"' || event_type || '","b":' || user_id || '}' AS canonical, sha256('{"a":"' || event_type || '","b":' || user_id || '}') AS digest FROM events
""")
def canonical_rows(spark, d):
    own = nested.canonical_json(F.to_json(F.struct(F.col("user_id").alias("b"), F.col("event_type").alias("a"))))
    return table(spark, d, "events").select("event_id", own.alias("canonical")).withColumn("digest", F.sha2("canonical", 256))


@query("""
WITH e AS (SELECT event_id, event_id % 4 AS k, event_type AS t, props AS p FROM events)
SELECT event_id, CASE k WHEN 0 THEN NULL WHEN 1 THEN t WHEN 2 THEN p ELSE t || p END AS strict, CASE k WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN p ELSE t || p END AS final,
  CASE k WHEN 0 THEN t || ' <think>' || p WHEN 1 THEN '<THINK x>' || p || chr(10) || '</think >' || t ELSE p END AS after FROM e
""")
def thoughts_left_out(spark, d):
    """The three rules for think blocks on texts with open, spaced, no and two blocks."""
    kind, t, p = F.col("event_id") % 4, F.col("event_type"), F.col("props")
    said = F.when(kind == 0, F.concat(t, F.lit(" <think>"), p)).when(kind == 1, F.concat(F.lit("<THINK x>"), p, F.lit("\n</think >"), t)).when(kind == 2, p).otherwise(F.concat(F.lit("<think>a</think>"), t, F.lit("<think>b\n</think>"), p))
    return table(spark, d, "events").select("event_id", text.without_thinking(said).alias("strict"), text.final_text(said).alias("final"), text.after_thinking(said).alias("after"))


@query("""
WITH e AS (SELECT event_id, user_id AS u, event_id % 7 + 1 AS n, user_id % 3 AS p FROM events)
SELECT event_id, CASE WHEN p < n THEN round(len(list_filter(range(p + 1, n + 1), lambda x: (x + u) % 4 <> 0)) / (n - p), 6) END AS accuracy,
  array_to_string(list_transform(range(4), lambda i: CASE WHEN n <= 4 THEN least(i + 1, n) ELSE CAST(floor(i * (n - 1) / 3.0) AS BIGINT) + 1 END), ',') AS spread,
  array_to_string(list_filter(range(1, n + 1), lambda x: n <= 3 OR x IN (2, 5) OR x - CAST(x > 2 AS INTEGER) - CAST(x > 5 AS INTEGER) <= 3 - 1 - CAST(n >= 5 AS INTEGER)), ',') AS cut,
  n >= 5 AND n <> 6 AS limited FROM e
""")
def training_columns(spark, d):
    """Accuracy over what counts, positions at even distances, cuts that keep special ids, and generations cut by their limit, of rows of any length."""
    ids = F.sequence(F.lit(1), (F.col("event_id") % 7 + 1).cast("int"))
    said = F.transform(ids, lambda x: F.when((x + F.col("user_id")) % 4 == 0, 0).otherwise(x))
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    return table(spark, d, "events").select(
        "event_id",
        F.round(training.token_accuracy(said, training.labels(ids, F.col("user_id") % 3)), 6).alias("accuracy"),
        join(training.spread(ids, 4)).alias("spread"),
        join(training.cut_but_special(ids, [2, 5], 3)).alias("cut"),
        training.limit_reached(ids, F.lit(5), [6]).alias("limited"),
    )


@query("""
SELECT p_partkey, 'type：' || p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'brand：' || p_brand ELSE '' END AS labelled, p_type AS first, CAST(2 AS INTEGER) AS n, p_name || '!' AS noted, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS merged FROM part
""")
def report_fields(spark, d):
    even = F.col("p_partkey") % 2 == 0
    brand = F.when(even, F.col("p_brand")).otherwise(" ")
    listed = report.items(F.concat(F.lit("- "), "p_type", F.lit("；2) "), "p_name", F.lit("\n ")))
    return table(spark, d, "part").select("p_partkey", report.labelled({"type": F.col("p_type"), "brand": brand}).alias("labelled"), F.get(listed, F.lit(0)).alias("first"), F.size(listed).alias("n"), report.with_notice(F.col("p_name"), "!", "x").alias("noted"), report.merged(F.col("p_type"), brand).alias("merged"))


# indexes, keywords and streams


_SIMILAR = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS l FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_inner_product(q.e, c.e) / (q.l * c.l), 6) AS similarity FROM n q JOIN n c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, id, similarity FROM r WHERE rank <= 10
"""


def _searched(spark, d, exact):
    e = table(spark, d, "embeddings")
    path = scratch(spark, "index")
    index.build(e, "vec_id", "embedding", path)
    return index.search(spark, path, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, exact=exact)


@query()
def index_search(spark, d):
    """The ten most similar rows in the nearest lists; a test holds its recall against the exact answer."""
    return _searched(spark, d, False)


@query(_SIMILAR)
def index_search_exact(spark, d):
    """The same index, searched until the triangle inequality rules out every other list."""
    return _searched(spark, d, True)


@query(r"""
WITH k AS (SELECT DISTINCT array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')[1:3], ' ') AS keyword FROM benchmark),
l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS leaf, t[i] AS text FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, [lang, source] || string_split(text, chr(10)) AS t FROM documents))),
c AS MATERIALIZED (SELECT doc_id, leaf, keyword, lower(text) AS text FROM l JOIN k ON keyword <> '' AND contains(lower(text), split_part(keyword, ' ', 1)) AND contains(lower(text), split_part(keyword, ' ', 2)) AND contains(lower(text), split_part(keyword, ' ', 3)))
SELECT doc_id, leaf, keyword FROM c WHERE regexp_matches(text, '(^|[^\p{L}\p{M}\p{N}_])' || replace(keyword, ' ', '\s+') || '([^\p{L}\p{M}\p{N}_]|$)')
""")
def keyword_hits(spark, d):
    """The first three words of each benchmark item, looked for in every field and line of every document."""
    first = F.slice(F.array_remove(F.split(F.lower("text"), "[^a-z0-9]+"), ""), 1, 3)
    words = [r["k"] for r in table(spark, d, "benchmark").select(F.array_join(first, " ").alias("k")).distinct().collect()]
    leaves = F.concat(F.array("lang", "source"), F.split("text", "\n"))
    return keywords.keyword_hits(table(spark, d, "documents").select("doc_id", leaves.alias("leaves")), "doc_id", "leaves", words)


@query("SELECT 'mira:train:' || p_partkey || ':open_ended:' || i AS id, p_partkey AS row_index, CAST(i AS INTEGER) AS qa_index, p_name || ' ' || i AS question FROM part, range(3) t(i)")
def resumed_samples(spark, d):
    """Samples read as a stream that stops within a row, is started again, and goes on there."""
    folder = scratch(spark, "samples")
    each = table(spark, d, "part").select("p_partkey", "p_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    rows = each.select(F.concat_ws(":", F.lit("mira:train"), F.col("p_partkey").cast("string"), F.lit("open_ended"), F.col("i").cast("string")).alias("id"), F.col("p_partkey").alias("row_index"), F.lit("open_ended").alias("category"), F.lit(0).alias("ord"), F.col("i").alias("qa_index"), F.concat_ws(" ", "p_name", F.col("i").cast("string")).alias("question"))
    samples.store_samples(rows, f"{folder}/stored")
    samples.register(spark)
    for _ in range(2):
        stream = spark.readStream.format("qa_samples").option("path", f"{folder}/stored").option("samplesPerBatch", rows.count() // 2 + 1).option("progress", f"{folder}/place").option("samplesPerTask", 500).load()
        stream.writeStream.format("parquet").option("path", f"{folder}/read").option("checkpointLocation", f"{folder}/progress").trigger(once=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/read").select("id", "row_index", "qa_index", "question")


@query("""
SELECT CAST(user_id AS VARCHAR) AS request, CAST(count(*) AS INTEGER) AS payloads, last(event_type ORDER BY event_id) AS diagnosis, CAST(max(event_id) AS VARCHAR) AS findings FROM events GROUP BY user_id
""")
def streamed_reports(spark, d):
    """Each user's events as a server's event stream, cut in the middle of its lines, in two files, put together and folded."""
    from caravel.streaming import reports

    folder = scratch(spark, "reports")
    line = F.concat(F.lit('data: {"diagnosis": "'), "event_type", F.lit('", "findings": "'), F.col("event_id").cast("string"), F.lit('"}\n\n'))
    lines = ordering.running(table(spark, d, "events").select("event_id", "user_id", line.alias("line")), ["user_id"], ["event_id"], into="seq")
    pieces = lines.select(F.col("user_id").cast("string").alias("request"), F.explode(F.array(F.struct((F.col("seq") * 2).alias("seq"), F.substring("line", 1, 20).alias("c")), F.struct((F.col("seq") * 2 + 1).alias("seq"), F.substring("line", 21, 10_000).alias("c")))).alias("x"))
    pieces = pieces.select("request", "x.seq", F.encode("x.c", "utf-8").alias("chunk"), F.lit(False).alias("last"))
    tasks = 2 * spark.sparkContext.defaultParallelism  # batches follow the files: their number must not grow with the table
    for part in (1, 0):  # what is ahead of its time comes first
        pieces.filter(F.col("seq") % 2 == part).coalesce(tasks).write.mode("append").parquet(f"{folder}/chunks")
    stream = spark.readStream.schema("request string, seq long, chunk binary, last boolean").option("maxFilesPerTrigger", 4).parquet(f"{folder}/chunks")
    reports.stream_lines(stream).writeStream.format("parquet").option("path", f"{folder}/lines").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return reports.folded_reports(spark.read.parquet(f"{folder}/lines")).select("request", "payloads", "report.diagnosis", "report.findings")

"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caravel.functions import text, textmetrics
from caravel.operators import corpus, plugins, runs, sampling, stats, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, else in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def rounded(c, digits: int = 6):
    return F.round(c, digits)


# vectors


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS l FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_inner_product(q.e, c.e) / (q.l * c.l), 6) AS similarity
  FROM n q JOIN n c ON c.vec_id <> q.vec_id AND c.label <> q.label WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, id, similarity FROM r WHERE rank <= 5
""")
def topk_cosine_excl(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k_cosine(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 5, "label")


@query(SQL["topk_cosine_excl"].replace(" AND c.label <> q.label", "").replace("rank <= 5", "rank <= 10"))
def topk_block_matmul(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k_cosine(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)


@query("""
WITH v AS (SELECT vec_id, len(embedding) AS dims, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS l FROM embeddings)
SELECT CAST(dims AS INTEGER) AS dims, CASE WHEN dims <> 64 THEN 'dimension' WHEN abs(l - 1) > 0.001 THEN 'not_unit' ELSE '' END AS issues, count(*) AS n FROM v GROUP BY 1, 2
""")
def vector_validate(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.size("embedding").alias("dims"), F.array_join(vectors.issues(F.col("embedding"), 64), ",").alias("issues")).groupBy("dims", "issues").agg(F.count("*").alias("n"))


@query("""
SELECT label, CAST(position AS INTEGER) AS position, round(avg(CAST(x AS DOUBLE)), 6) AS value
FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS position FROM embeddings) GROUP BY label, position
""")
def vector_label_centroids(spark, d):
    return vectors.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").withColumn("value", rounded("value"))


@query("""
WITH k AS (SELECT o_orderkey FROM orders),
i AS (SELECT DISTINCT 'ord-' || CAST(o_orderkey AS VARCHAR) AS k FROM orders WHERE o_orderkey % 2 = 0),
f AS (SELECT 'plain' AS form, CAST(o_orderkey AS VARCHAR) AS k FROM k UNION ALL SELECT 'prefix', 'ord-' || CAST(o_orderkey AS VARCHAR) FROM k
  UNION ALL SELECT 'shifted', 'ord-' || CAST(o_orderkey + 1 AS VARCHAR) FROM k)
SELECT form, count(i.k) AS hits, count(*) AS asked FROM f LEFT JOIN i USING (k) GROUP BY form
""")
def id_reconcile_best_strategy(spark, d):
    o = table(spark, d, "orders")
    index = o.filter("o_orderkey % 2 = 0").select(F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string")).alias("id"))
    key = F.col("o_orderkey")
    forms = {"plain": key, "prefix": F.concat(F.lit("ord-"), key.cast("string")), "shifted": F.concat(F.lit("ord-"), (key + 1).cast("string"))}
    return vectors.best_key_form(o, "o_orderkey", forms, index, "id")


# samples


_TIER = "CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 1 THEN 1 WHEN toxic = 0 THEN 2 ELSE 3 END"


def _tier():
    good, mild = F.col("quality") == 1, F.col("toxic") == 0
    return F.when(good & mild, 0).when(good, 1).when(mild, 2).otherwise(3)


@query(f"""
WITH t AS (SELECT doc_id, lang, {_TIER} AS tier, sha256('42|test|' || doc_id) AS lot FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY tier, lot, doc_id) AS k FROM t)
SELECT doc_id, lang, tier FROM r WHERE k <= CASE lang WHEN 'en' THEN 20 WHEN 'de' THEN 10 WHEN 'fr' THEN 7 ELSE 0 END
""")
def stratified_quota_sample(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return sampling.quota_sample(rows, "doc_id", "lang", _tier(), {"en": 20, "de": 10, "fr": 7, "es": 0}, 42, "test").select("doc_id", "lang", "tier")


@query(f"""
SELECT doc_id, tier FROM (SELECT doc_id, {_TIER} AS tier, sha256('7|pool|' || doc_id) AS lot FROM documents LEFT JOIN labels USING (doc_id)) ORDER BY tier, lot, doc_id LIMIT 50
""")
def priority_sample_total(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return sampling.priority_sample(rows, "doc_id", _tier(), 50, 7, "pool").select("doc_id", "tier")


@query("""
WITH w AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT lang, 101.0::DOUBLE * n / sum(n) OVER () AS x FROM w),
r AS (SELECT lang, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang) AS k, 101 - sum(floor(x)) OVER () AS l FROM e)
SELECT lang, CAST(f + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r
""")
def largest_remainder_quota(spark, d):
    w = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return sampling.largest_remainder(w, "lang", "n", 101)


@query("""
WITH t AS (SELECT doc_id, lang, sha256('42|split|' || doc_id) AS lot FROM documents),
test AS (SELECT doc_id, lang FROM t WHERE lot < '2')
SELECT 'test' AS role, lang, count(*) AS n FROM test GROUP BY lang
UNION ALL SELECT 'train', lang, count(*) FROM t WHERE doc_id NOT IN (SELECT doc_id FROM test) GROUP BY lang
""")
def train_test_split_disjoint(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    test = docs.filter(sampling.lot(42, "split", F.col("doc_id")) < "2")
    train = docs.join(test.select("doc_id"), "doc_id", "left_anti")
    return test.withColumn("role", F.lit("test")).unionByName(train.withColumn("role", F.lit("train"))).groupBy("role", "lang").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey <= 40),
touched AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM t))
SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM touched) AND l_orderkey > 40 GROUP BY l_orderkey
""")
def shared_key_exclusion(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    kept = sampling.without_shared(lines, "l_orderkey", "l_partkey", lines.filter("l_orderkey <= 40"))
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n"))


def _wanted(spark) -> DataFrame:
    return spark.range(60).select(F.col("id").cast("int").alias("ord"), (F.lit(600) - F.col("id") * 11).alias("o_orderkey"))


@query("SELECT CAST(i AS INTEGER) AS ord, o_orderkey, o_orderstatus FROM range(60) w(i) JOIN orders ON o_orderkey = 600 - i * 11")
def semi_join_selected_ids(spark, d):
    return _wanted(spark).join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey").select("ord", "o_orderkey", "o_orderstatus")


@query("SELECT CAST(i AS INTEGER) AS ord, 600 - i * 11 AS o_orderkey FROM range(60) w(i) WHERE 600 - i * 11 NOT IN (SELECT o_orderkey FROM orders)")
def missing_ids_anti(spark, d):
    return _wanted(spark).join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_anti").select("ord", "o_orderkey")


@query("SELECT doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN 1 END, l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_backfill(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return runs.backfilled(own, table(spark, d, "labels"), "doc_id", ["quality", "toxic"]).fillna(-1)


@query("""
WITH a AS (SELECT DISTINCT doc_id AS k FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT doc_id AS k FROM labels)
SELECT count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS both
FROM a FULL JOIN b ON a.k = b.k
""")
def key_set_equality(spark, d):
    return stats.key_difference(table(spark, d, "documents").filter("doc_id % 2 = 0"), table(spark, d, "labels"), "doc_id")


@query("""
SELECT coalesce(lang, '*') AS lang, count(*) AS total, count(quality) AS labelled, count(*) - count(quality) AS missing, count(*) FILTER (WHERE quality = 1) AS good
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)
""")
def coverage_by_group(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    out = rows.rollup("lang").agg(F.count("*").alias("total"), F.count("quality").alias("labelled"), (F.count("*") - F.count("quality")).alias("missing"), F.count_if(F.col("quality") == 1).alias("good"))
    return out.withColumn("lang", F.coalesce("lang", F.lit("*")))




@query("""
SELECT user_id % 10 AS bucket, count(*) FILTER (WHERE event_type = 'click') AS click_n, count(*) FILTER (WHERE event_type = 'click' AND value > 50) AS click_large,
  count(*) FILTER (WHERE event_type = 'error') AS error_n, count(*) FILTER (WHERE event_type = 'error' AND value > 50) AS error_large FROM events GROUP BY 1
""")
def selected_pivot_counts(spark, d):
    rows = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("bucket"))
    return rows.pivot("event_type", ["click", "error"]).agg(F.count("event_id").alias("n"), F.count_if(F.col("value") > 50).alias("large")).fillna(0)


@query("""
SELECT o_orderpriority, CAST(coalesce(sum(n) FILTER (WHERE o_orderstatus = 'F'), 0) AS BIGINT) AS f, CAST(coalesce(sum(n) FILTER (WHERE o_orderstatus = 'O'), 0) AS BIGINT) AS o, CAST(coalesce(sum(n) FILTER (WHERE o_orderstatus = 'P'), 0) AS BIGINT) AS p
FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1
""")
def category_pivot(spark, d):
    wide = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return wide.select("o_orderpriority", *[F.col(x).alias(x.lower()) for x in "FOP"])


# statistics


@query("""
WITH m AS (SELECT l_returnflag, 'discount' AS metric, CASE WHEN l_linenumber <> 3 THEN l_discount END AS value FROM lineitem
  UNION ALL SELECT l_returnflag, 'tax', l_tax FROM lineitem)
SELECT coalesce(l_returnflag, '*') AS l_returnflag, metric, count(value) AS n, count(*) AS total, round(count(value) / count(*), 6) AS coverage, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM m GROUP BY GROUPING SETS ((metric), (metric, l_returnflag))
""")
def metric_summary_by_type(spark, d):
    metrics = {"discount": F.when(F.col("l_linenumber") != 3, F.col("l_discount")), "tax": F.col("l_tax")}
    out = stats.metric_summary(table(spark, d, "lineitem"), "l_returnflag", metrics)
    return out.select("l_returnflag", "metric", "n", "total", *[rounded(c).alias(c) for c in ("coverage", "mean", "std")])


@query("""
WITH g AS (SELECT lang, count(quality) AS n, avg(quality) AS p FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang),
z AS (SELECT 1.959963984540054::DOUBLE AS z),
c AS (SELECT lang, n, p, (p + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS r FROM g, z)
SELECT lang, n, round(p, 6) AS mean, round(greatest(0, m - r), 6) AS ci_low, round(least(1, m + r), 6) AS ci_high FROM c
""")
def wilson_interval(spark, d):
    g = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("quality").alias("n"), F.avg("quality").alias("p"))
    low, high = stats.wilson(F.col("p"), F.col("n"))
    return g.select("lang", "n", rounded("p").alias("mean"), rounded(low).alias("ci_low"), rounded(high).alias("ci_high"))


def _mixed(level: int, *numbers: str, salt: int) -> str:
    return f"({' + '.join(f'{x} * {m}' for x, m in zip(numbers, (48271, 69621, 16807), strict=True))} + {level * 1299709 + salt}) % {stats.PRIME}"


def _fifth(x: str, more: int) -> str:
    square = f"({x} * {x} % {stats.PRIME})"
    return f"(({square} * {square}) % {stats.PRIME} * {x} + {more}) % {stats.PRIME}"


def _draws(name: str, source: str, keep: str, level: int, *numbers: str) -> str:
    """Tables of a draw's two numbers, x and z, mixed twice."""
    steps = [f"{name}0 AS (SELECT {keep}, {_mixed(level, *numbers, salt=42)} AS x, {_mixed(level, *numbers, salt=42 + 77_777)} AS z FROM {source})"]
    steps += [f"{name}{i} AS (SELECT {keep}, {_fifth('x', k)} AS x, {_fifth('z', k)} AS z FROM {name}{i - 1})" for i, k in enumerate(stats.ROUNDS, 1)]
    return ",\n".join(steps)


@query(f"""
WITH r AS (SELECT c_mktsegment AS g, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS k FROM customer WHERE c_acctbal IS NOT NULL),
n AS (SELECT g, count(*) AS n, avg(v) AS mean, greatest({stats.BLOCK}, count(*) // {stats.BLOCKS}) AS s FROM r GROUP BY g),
d AS (SELECT g, n, s, b, unnest(range(n)) AS j FROM n, range(200) t(b)),
{_draws("a", "d", "g, n, s, b", 1, "j", "b", "0")},
m AS (SELECT g, n, s, b, (x * 2147483648 + z) % n // s AS p, count(*) AS m FROM a2 GROUP BY ALL),
e AS (SELECT g, n, s, b, p, unnest(range(m)) AS i FROM m),
{_draws("c", "e", "g, n, s, b, p", 2, "i", "b", "p")},
f AS (SELECT g, b, p * s + (x * 2147483648 + z) % least(s, n - p * s) AS k FROM c2),
t AS (SELECT g, b, avg(v) AS m, count(*) AS draws FROM f JOIN r USING (g, k) GROUP BY g, b)
SELECT g AS c_mktsegment, any_value(n.n) AS n, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM t JOIN n USING (g) WHERE draws = n.n GROUP BY g
""")
def bootstrap_ci(spark, d):
    out = stats.bootstrap(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "c_custkey", 200)
    return out.select("c_mktsegment", "n", *[rounded(c).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query("SELECT lang, count(x) AS n, count(*) AS total, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT doc_id, quality - toxic AS x FROM labels) JOIN documents USING (doc_id) GROUP BY lang")
def paired_delta(spark, d):
    own = table(spark, d, "labels")
    delta = stats.paired(own.select("doc_id", F.col("quality").alias("v")), own.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")
    n, total, _, mean, std = stats.summary_columns(F.col("delta"))
    return delta.join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(n, total, rounded(mean).alias("mean"), rounded(std).alias("std"))


# runs


@query("""
WITH p AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_size % 7 <> 0 THEN p_size END AS s FROM part)
SELECT a.p_partkey AS fine, b.p_partkey AS base FROM p a JOIN p b ON a.p_type IS NOT DISTINCT FROM b.p_type AND a.s IS NOT DISTINCT FROM b.s WHERE a.p_brand = 'Brand#1' AND b.p_brand <> 'Brand#1'
""")
def run_pairing_theta(spark, d):
    p = table(spark, d, "part").withColumn("s", F.when(F.col("p_size") % 7 != 0, F.col("p_size")))
    return runs.compatible_pairs(p, "p_partkey", F.col("p_brand") == "Brand#1", ["p_type", "s"])


@query("""
WITH m AS (SELECT s_nationkey, avg(s_acctbal) AS b FROM supplier GROUP BY 1)
SELECT s_suppkey, round(abs(s_acctbal - b), 6) AS difference FROM supplier JOIN m USING (s_nationkey) ORDER BY 2 DESC, 1 LIMIT 10
""")
def top10_abs_diff(spark, d):
    s = table(spark, d, "supplier")
    means = s.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("b"))
    other = s.join(means, "s_nationkey").select("s_suppkey", F.col("b").alias("v"))
    out = runs.largest_difference(s.select("s_suppkey", F.col("s_acctbal").alias("v")), other, "s_suppkey", "v", 10)
    return out.withColumn("difference", rounded("difference"))


@query("""
WITH c AS (SELECT lang, CASE WHEN trim(coalesce(source, '')) = '' THEN 'missing_question' WHEN trim(text) = '' THEN 'missing_answer' WHEN regexp_matches(trim(text), '(?i)^https?://\\S+$') THEN 'url_only' ELSE 'usable' END AS k FROM documents)
SELECT coalesce(lang, 'TOTAL') AS lang, count(*) AS total, count(*) FILTER (WHERE k = 'missing_question') AS missing_question, count(*) FILTER (WHERE k = 'missing_answer') AS missing_answer,
  count(*) FILTER (WHERE k = 'url_only') AS url_only, count(*) FILTER (WHERE k = 'usable') AS usable FROM c GROUP BY ROLLUP (lang)
""")
def exclusive_class_counts(spark, d):
    docs = table(spark, d, "documents")
    return corpus.class_counts(docs, "lang", corpus.pair_class(F.col("source"), F.col("text")))


@query("SELECT event_id, coalesce(nullif(trim(json_extract_string(props, '$.name')), ''), nullif(trim(json_extract_string(props, '$.k')), ''), '') AS first FROM events")
def first_nonempty_alias(spark, d):
    get = lambda k: F.get_json_object("props", f"$.{k}")
    return table(spark, d, "events").select("event_id", text.first_text(get("name"), get("k")).alias("first"))


@query("""
WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(i - 1 AS INTEGER) AS position, CAST(length(t[i]) AS BIGINT) AS chars FROM (SELECT conv_id, t, unnest(range(1, len(t) + 1)) AS i FROM c)
""")
def json_flatten_explode(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    doc = rows.select("conv_id", F.to_json(F.struct(F.transform("m", lambda x: x["text"]).alias("turns"))).alias("j"))
    turns = F.from_json("j", "map<string,array<string>>")["turns"]
    return doc.select("conv_id", F.posexplode(turns).alias("position", "t")).select("conv_id", "position", F.char_length("t").cast("long").alias("chars"))


@query("""
SELECT 'mira:train:' || l_orderkey || ':single_choice:' || l_linenumber AS id, l_orderkey AS "row", l_linenumber AS index, 'single_choice' AS category, 'train' AS split FROM lineitem
""")
def stable_id_build_parse(spark, d):
    rows = table(spark, d, "lineitem").select(text.sample_id(F.lit("train"), F.col("l_orderkey"), F.lit("single_choice"), F.col("l_linenumber")).alias("id"))
    return rows.select("id", text.parsed_id(F.col("id")).alias("p")).select("id", "p.row", "p.index", "p.category", "p.split")


# chats


_CHAT = """
WITH m AS (SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE trim(text) <> ''),
l AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS last, bool_or(role = 'system') AS has FROM m GROUP BY conv_id),
k AS (SELECT m.*, last, has FROM m JOIN l USING (conv_id) WHERE turn <= last),
g AS (SELECT conv_id, count(*) + CASE WHEN any_value(has) THEN 0 ELSE 1 END AS n_messages, min_by(text, turn) FILTER (WHERE role = 'user') AS question, max_by(text, turn) AS answer, string_agg(role, ',' ORDER BY turn) AS roles, any_value(has) AS has FROM k GROUP BY conv_id)
"""


@query(_CHAT + "SELECT conv_id, CASE WHEN has THEN roles ELSE 'system,' || roles END AS roles, sha256(question) AS question, sha256(answer) AS answer FROM g WHERE n_messages >= 3")
def chat_normalize(spark, d):
    rows = corpus.collected_turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    fine = rows.select("conv_id", corpus.normalized_chat(F.col("messages"), "You are a careful assistant.").alias("m")).filter("m is not null")
    return fine.select("conv_id", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.sha2(corpus.first_user(F.col("m")), 256).alias("question"), F.sha2(corpus.last_answer(F.col("m")), 256).alias("answer"))


@query("""
SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (WHERE role = 'user') AS users, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS rendered FROM conversations GROUP BY conv_id
""")
def chat_messages_array(spark, d):
    rows = corpus.collected_turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    chars = F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.char_length(m["content"]))
    return rows.select("conv_id", F.size("messages").cast("long").alias("n"), chars.alias("chars"), F.size(F.filter("messages", lambda m: m["role"] == "user")).cast("long").alias("users"), F.sha2(said, 256).alias("rendered"))


@query("""
SELECT conv_id, turn, CAST(instr(said, answer) - 1 AS BIGINT) AS prefix_chars FROM (
  SELECT conv_id, turn, text AS answer, 'question: ' || lag(text) OVER (PARTITION BY conv_id ORDER BY turn) || ' answer: ' || text AS said, role FROM conversations)
WHERE role = 'assistant' AND said IS NOT NULL
""")
def supervised_prefix(spark, d):
    c = table(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    rows = c.filter("role = 'assistant'").join(before, ["conv_id", "turn"]).withColumn("said", F.concat(F.lit("question: "), "q", F.lit(" answer: "), "text"))
    return rows.select("conv_id", "turn", F.char_length(corpus.supervised_prefix(F.col("said"), F.col("text"))).cast("long").alias("prefix_chars"))


# texts


KEYWORDS = ["the of", "of the", "Thation (TH)", "ou le", "la de", "der die"]


@query(r"""
SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\pL\pM\pN_])(the\s+of|of\s+the|thation|th|ou\s+le|la\s+de|der\s+die)($|[^\pL\pM\pN_])')
""")
def keyword_match(spark, d):
    return table(spark, d, "documents").filter(corpus.mentions(F.array("text"), KEYWORDS)).select("doc_id")


@query(r"SELECT page_id, regexp_matches(trim(url), '(?i)^https?://\S+$') AS url_only, regexp_matches(trim(html), '(?i)^https?://\S+$') AS html_only FROM pages")
def url_only_filter(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_only(F.col("url")).alias("url_only"), text.url_only(F.col("html")).alias("html_only"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_type, 'PROMO') AND contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def search_filter(spark, d):
    said = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return table(spark, d, "part").filter(F.col("p_type").contains("PROMO") & said.contains("brand#1")).select("p_partkey", "p_name")


@query("""
WITH c AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[㐀-䶿一-鿿豈-﫿]', '', 'g')) AS o FROM documents)
SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(1, n - o + ceil(o / 4)) END AS BIGINT) AS tokens FROM c
""")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CAST(CASE WHEN n_chars >= 4096 / 1.5 THEN 4096 ELSE least(4096, greatest(64, ceil(n_chars * 1.5) + 3)) END AS BIGINT) AS budget FROM documents")
def token_budget_clamp(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_budget(F.col("n_chars"), 1.5, 3, 64, 4096).alias("budget"))


@query("""
WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS p, list_sort(list(DISTINCT l_linestatus)) AS q FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey, p, list_transform(q, lambda x: CASE WHEN x = 'F' THEN 'A' ELSE 'N' END) AS q FROM a),
c AS (SELECT l_orderkey, len(p) AS n, len(q) AS m, len(list_intersect(p, q)) AS k FROM b)
SELECT l_orderkey, CASE WHEN k = n AND k = m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy, round(2.0::DOUBLE * k / (n + m), 6) AS f1 FROM c
""")
def choice_f1_accuracy(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("p"), F.collect_set(F.when(F.col("l_linestatus") == "F", "A").otherwise("N")).alias("q"))
    accuracy, f1 = runs.choice_scores(F.col("p"), F.col("q"))
    return rows.select("l_orderkey", accuracy.alias("accuracy"), rounded(f1).alias("f1"))


@query(r"""
WITH i AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS s FROM benchmark),
d AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, trim(unnest(string_split_regex(text, '[。！？!?；;\n]+'))) AS c FROM documents),
k AS (SELECT DISTINCT doc_id, item_id, c FROM d WHERE c <> ''),
w AS (SELECT doc_id, c, list_distinct(list_filter(string_split_regex(lower(c), '[^a-z0-9]+'), lambda x: x <> '')) AS v, s FROM k JOIN i USING (item_id)),
o AS (SELECT doc_id, CASE WHEN len(v) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(v, s))::DOUBLE / len(v) END AS x FROM w)
SELECT doc_id, count(*) AS n, round(avg(CASE WHEN x >= 0.8 THEN 1.0::DOUBLE WHEN x >= 0.4 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS score FROM o GROUP BY doc_id
""")
def keyword_overlap_fact(spark, d):
    n = table(spark, d, "benchmark").count()
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % n).alias("item_id"), corpus.claims(F.col("text")).alias("c")).filter("size(c) > 0")
    items = table(spark, d, "benchmark").select("item_id", corpus.word_set(F.col("text")).alias("s"))
    # an item joins a document once, and its claims are scored where they lie
    scored = docs.join(items, "item_id").select("doc_id", F.transform("c", lambda c: corpus.overlap_score(corpus.word_set(c), F.col("s"))).alias("x"))
    return scored.select("doc_id", F.size("x").cast("long").alias("n"), rounded(F.aggregate("x", F.lit(0.0), lambda s, x: s + x) / F.size("x")).alias("score"))


def _token_pairs(spark, d):
    b = table(spark, d, "benchmark").select("item_id", textmetrics.tokens(F.col("text")).alias("a"))
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")


@query(r"""
WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]|[0-9_\p{L}]+') AS w FROM benchmark),
p AS (SELECT a.item_id, a.w AS p, b.w AS r FROM t a JOIN t b ON b.item_id = a.item_id + 1),
k AS (SELECT * FROM p, (VALUES (1), (2), (3), (4)) n(n)),
x AS (SELECT item_id, n, g, count(*) AS c FROM (SELECT item_id, n, array_to_string(p[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(p) - n + 2)) AS i FROM k)) GROUP BY 1, 2, 3),
y AS (SELECT item_id, n, g, count(*) AS c FROM (SELECT item_id, n, array_to_string(r[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM k)) GROUP BY 1, 2, 3),
h AS (SELECT item_id, n, sum(x.c) AS total, sum(CASE WHEN y.c IS NULL THEN 0 ELSE least(x.c, y.c) END) AS hit FROM x LEFT JOIN y USING (item_id, n, g) GROUP BY 1, 2),
l AS (SELECT item_id, min(hit) AS least, count(*) AS orders, avg(ln(CASE WHEN hit > 0 THEN hit / total END)) AS s FROM h GROUP BY 1)
SELECT item_id, round(CASE WHEN least = 0 OR orders < 4 THEN 0.0::DOUBLE ELSE exp(s) * CASE WHEN len(p) > len(r) THEN 1.0 ELSE exp(1 - len(r) / len(p)) END END, 6) AS bleu4, 1.0::DOUBLE AS own FROM p JOIN l USING (item_id)
""")
def bleu4(spark, d):
    rows = _token_pairs(spark, d)
    return rows.select("item_id", rounded(textmetrics.bleu_score("a", "b")).alias("bleu4"), rounded(textmetrics.bleu_score("a", "a")).alias("own"))


@query(r"""
WITH RECURSIVE t AS (SELECT item_id, regexp_extract_all(lower(text), '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]|[0-9_\p{L}]+') AS w FROM benchmark),
p AS (SELECT a.item_id, a.w AS p, b.w AS r FROM t a JOIN t b ON b.item_id = a.item_id + 1),
d(item_id, i, row_) AS (
  SELECT item_id, 0, list_transform(range(0, len(r) + 1), lambda x: CAST(0 AS BIGINT)) FROM p
  UNION ALL
  SELECT item_id, i + 1, list_reduce([[CAST(0 AS BIGINT)]] || list_transform(range(1, len(r) + 1), lambda j: [j]),
    lambda acc, x: list_append(acc, CASE WHEN p[i + 1] = r[x[1]] THEN row_[x[1]] + 1 ELSE greatest(row_[x[1] + 1], acc[len(acc)]) END))
  FROM d JOIN p USING (item_id) WHERE i < len(p))
SELECT item_id, round(2.0::DOUBLE * row_[len(r) + 1] / (len(p) + len(r)), 6) AS rouge_l, 1.0::DOUBLE AS own FROM d JOIN p USING (item_id) WHERE i = len(p)
""")
def rouge_l(spark, d):
    rows = _token_pairs(spark, d)
    return rows.select("item_id", rounded(textmetrics.rouge_score("a", "b")).alias("rouge_l"), rounded(textmetrics.rouge_score("a", "a")).alias("own"))


@query("""
SELECT page_id, CAST(i AS INTEGER) AS part, sha256(html[i * 15000 + 1 : (i + 1) * 15000]) AS sha FROM (SELECT page_id, html, unnest(range(greatest(1, CAST(ceil(length(html) / 15000.0) AS BIGINT)))) AS i FROM pages)
""")
def chunk_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(text.chunks(F.col("html"), 15000)).alias("part", "c")).select("page_id", "part", F.sha2("c", 256).alias("sha"))


@query("SELECT page_id, sha256(html) AS sha, CAST(greatest(1, ceil(length(html) / 1000.0)) AS BIGINT) AS parts FROM pages")
def chunk_restore(spark, d):
    parts = table(spark, d, "pages").select("page_id", F.posexplode(text.chunks(F.col("html"), 1000)).alias("part", "c"))
    return parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("part", "c"))).alias("x")).select("page_id", F.sha2(F.array_join(F.transform("x", lambda x: x["c"]), ""), 256).alias("sha"), F.size("x").cast("long").alias("parts"))


@query("SELECT doc_id, sha256(CASE WHEN substr(ltrim(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1, 1) IN ('=', '+', '-', '@') THEN '''' || t ELSE t END) AS safe_sha FROM (SELECT doc_id, (CASE doc_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' WHEN 3 THEN chr(9) || ' +' ELSE '' END) || text AS t FROM documents)")
def formula_neutralise(spark, d):
    mark = F.when(F.col("doc_id") % 5 == 0, "=").when(F.col("doc_id") % 5 == 1, "-").when(F.col("doc_id") % 5 == 2, "@").when(F.col("doc_id") % 5 == 3, "\t +").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.sha2(text.neutral_formula(F.concat(mark, "text")), 256).alias("safe_sha"))


@query("SELECT o_orderkey, sha256(CAST(o_custkey AS VARCHAR) || chr(31) || coalesce(o_orderstatus, chr(0)) || chr(31) || o_orderpriority) AS fingerprint FROM orders")
def fingerprint_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.fingerprint(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("fingerprint"))


@query("SELECT doc_id, CASE WHEN length(t) > 80 THEN t[1:80] || '...' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def preview_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text"), 80).alias("preview"))


# caches, retrieval, review


@query("""
WITH c AS (SELECT o_orderkey, o_orderdate AS v, CASE WHEN o_orderkey % 4 = 0 THEN 'old' ELSE 'new' END AS f FROM orders WHERE o_orderkey % 3 <> 0),
l AS (SELECT o_orderkey, f FROM c)
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l WHERE f = 'new')
""")
def cache_anti_join(spark, d):
    o = table(spark, d, "orders")
    stored = o.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "old").otherwise("new").alias("f"), F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))
    current = runs.latest(stored, ["o_orderkey"], [F.desc("version")])
    return runs.cache_misses(o.select("o_orderkey", F.lit("new").alias("f")), current, "o_orderkey", "f").select("o_orderkey")


@query("""
WITH r AS (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM customer JOIN orders ON c_custkey = o_custkey)
SELECT run, c_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM r JOIN (VALUES ('a', 2), ('b', 5)) k(run, k) ON rank <= k
""")
def max_k_shared_retrieval(spark, d):
    from pyspark.sql import Window

    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    ranked = orders.withColumn("rank", F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    asked = table(spark, d, "customer").select("c_custkey", F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(k).alias("k")) for r, k in (("a", 2), ("b", 5))])).alias("x")).select("c_custkey", "x.run", "x.k")
    return runs.shared_retrieval(asked, "run", "c_custkey", "k", ranked).select("run", "c_custkey", "o_orderkey", "rank")


@query("""
SELECT doc_id, concat_ws('；', CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN quality = 0 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS reasons
FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars < 100 OR quality = 0 OR toxic = 1
""")
def review_queue(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    found = rows.select("doc_id", runs.review_reasons({"short": F.col("n_chars") < 100, "quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}).alias("reasons"))
    return found.filter("reasons <> ''")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE n_chars >= 200) WHERE k <= 3")
def limit_per_source(spark, d):
    return sampling.limit_each(table(spark, d, "documents").filter("n_chars >= 200").select("source", "doc_id"), "source", [F.col("doc_id")], 3)


@query("SELECT 'train' AS split, doc_id FROM documents WHERE doc_id % 10 < 8 UNION ALL SELECT 'validation', doc_id FROM documents WHERE doc_id % 10 = 8 UNION ALL SELECT 'test', doc_id FROM documents WHERE doc_id % 10 = 9")
def union_splits(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    parts = [docs.filter(c).select(F.lit(n).alias("split"), "doc_id") for n, c in (("train", "doc_id % 10 < 8"), ("validation", "doc_id % 10 = 8"), ("test", "doc_id % 10 = 9"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'only_customer', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
""")
def overlap_intersect(spark, d):
    a, b = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey")
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("kind"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.subtract(b), "only_customer"))


@query("SELECT n_name, count(*) AS n, string_agg(s_name, ',' ORDER BY s_name) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def group_collect(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("suppliers"))


@query()
def encode_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text"))
    return plugins.encoded(docs, "text").select("doc_id", F.size("embedding").alias("dims"), rounded(vectors.norm(F.col("embedding")), 3).alias("norm"))


# joins and sums of the star schema, as a user of the corpus tables would ask them


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(rounded(F.sum("l_quantity"), 2).alias("sum_qty"), rounded(revenue, 2).alias("revenue"), rounded(F.avg("l_discount")).alias("avg_disc"), F.count("*").alias("n"))


def _event_fields(spark, d) -> T.StructType:
    return table(spark, d, "events").schema


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_event_counts(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS keys FROM events GROUP BY event_type")
def incremental_ingest(spark, d):
    """The events through the resumable ingest, twice: a second run stores nothing again."""
    from caravel.streaming.ingest import ingest

    folder = scratch(spark, "ingest")
    for run in range(2):
        stream = spark.readStream.schema(_event_fields(spark, d)).parquet(f"{d}/events.parquet*")
        ingest(stream, "event_id", f"{folder}/stored", f"{folder}/progress-{run}", order="ts", config={"fields": "all"}, buckets=32).awaitTermination()
    return spark.read.parquet(f"{folder}/stored").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("keys"))


from caravel.plans import corpora, evaluation, records  # noqa: E402, F401  they add their queries

"""Question-answer sources: image-row CSV with nested JSON, JSON lines, manifests, keyword files."""

from __future__ import annotations

import ast
import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caravel.functions.text import ID_FORM, json_value, sample_id
from caravel.operators.sampling import TYPES
from caravel.session import settled
from caravel.sources.quoted import records

QA = "map<string,array<variant>>"


def read_image_rows(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(split, row_index, image_path, caption, vqa_json) of a split's CSV, read by many tasks; quoted fields may span lines.

    A path of several files is refused, as the numbers of their rows would mix.
    A row with other than the head's number of fields raises.  Write the result
    as Parquet once; all later work reads that.
    """
    if len(found := spark.read.text(path, wholetext=True).inputFiles()) != 1:
        raise ValueError(f"{path}: one file is needed, {len(found)} found")
    rows = records(spark, path)
    head = rows.filter("record = 0").first()
    names = next(csv.reader(io.StringIO(head["text"], newline=""))) if head else []
    lost = {"image_path", "vqa_json"} - set(names)
    if lost:
        raise ValueError(f"{path}: no column {', '.join(sorted(lost))}")
    kinds = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    row = F.from_csv("text", kinds.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"quote": '"', "escape": '"', "mode": "FAILFAST"})
    field = lambda n: F.col(f"r.c{names.index(n)}")
    caption = F.coalesce(field("caption"), F.lit("")) if "caption" in names else F.lit("")
    read = rows.filter("record > 0").select((F.col("record") - 1).alias("row_index"), row.alias("r"))
    return read.select(F.lit(split).alias("split"), "row_index", field("image_path").alias("image_path"), caption.alias("caption"), field("vqa_json").alias("vqa_json"))


@F.arrow_udf(T.ArrayType(T.StringType()))
def literal_list(text: pa.Array) -> pa.Array:
    """The texts of a list or tuple written as a Python literal; null for anything else."""

    def read(value: str | None) -> list[str] | None:
        try:
            found = ast.literal_eval(value) if value is not None else None
        except (ValueError, SyntaxError):
            return None
        return [str(x) for x in found] if isinstance(found, (list, tuple)) else None

    return pa.array([read(x) for x in text.to_pylist()], pa.list_(pa.string()))


def image_list(value: Column) -> Column:
    """A path, a JSON list or a list in quotes of either kind -> trimmed paths with forward slashes."""
    flat = F.trim(value)
    json = F.from_json(flat, "array<string>")
    listed = F.coalesce(json, literal_list(F.when(flat.rlike(r"^[\[(]") & json.isNull(), flat)))
    many = F.when(flat.rlike(r"^[\[(]"), listed).otherwise(F.array(flat))
    return F.filter(F.transform(many, lambda x: F.replace(F.trim(x), F.lit("\\"), F.lit("/"))), lambda x: x != "")


def _clean_path(path: Column) -> Column:
    """The path without ``.``, doubled slashes, and ``..`` behind a folder, to any depth."""
    flat = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(flat, "/"), lambda x: ~x.isin("", "."))
    root = flat.startswith("/")
    last = lambda s: F.try_element_at(s, F.lit(-1))
    step = lambda s, x: F.when((x == "..") & (F.size(s) > 0) & (last(s) != ".."), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when((x == "..") & root, s).otherwise(F.concat(s, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(root, "/").otherwise(""), F.array_join(kept, "/"))


def placed(path: Column, root: str) -> Column:
    """A path inside ``root`` unless it is absolute; one with a scheme is an error."""
    return F.when(path.contains("://"), F.raise_error(F.concat(F.lit("no local path: "), path)).cast("string")).when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def image_keys(paths: Column) -> Column:
    """Distinct paths with ``.``, ``..`` and doubled slashes resolved."""
    return F.array_distinct(F.transform(paths, _clean_path))


def flatten(rows: DataFrame) -> DataFrame:
    """One row for each question-answer pair, in the order of ``TYPES``; unknown types and empty rows are errors."""
    qa = F.from_json("vqa_json", QA)
    known = rows.withColumn("_qa", qa)
    wrong = F.exists(F.map_keys("_qa"), lambda k: ~k.isin(*TYPES))
    where = F.concat(F.col("split"), F.lit(" row "), (F.col("row_index") + 1).cast("string"))
    none = F.coalesce(F.aggregate(F.map_values("_qa"), F.lit(0), lambda n, v: n + F.coalesce(F.size(v), F.lit(0))), F.lit(0)) == 0
    checked = known.withColumn("_qa", F.when(F.col("_qa").isNull(), F.raise_error(F.concat(where, F.lit(": vqa_json is no object of lists")))).when(wrong, F.raise_error(F.concat(where, F.lit(": unknown question type")))).when(none, F.raise_error(F.concat(where, F.lit(": no question")))).otherwise(F.col("_qa")))
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(t).alias("category"), F.coalesce(F.col("_qa")[t], F.array().cast("array<variant>")).alias("qas")) for i, t in enumerate(TYPES)])
    out = checked.select("split", "row_index", "image_path", "caption", F.explode(each).alias("c")).select("split", "row_index", "image_path", "caption", "c.ord", "c.category", F.posexplode("c.qas").alias("qa_index", "qa"))
    get = lambda name: F.try_variant_get("qa", f"$.{name}", "string")
    own = F.coalesce(get("image_path"), get("image_paths"))
    answer = get("answer")
    missing = F.array_compact(F.array(F.when(F.coalesce(get("question"), F.lit("")) == "", "question"), F.when(answer.isNull() | answer.isin("", "{}", "[]"), "answer")))
    return out.select(
        sample_id(F.col("split"), F.col("row_index"), F.col("category"), F.col("qa_index")).alias("id"),
        "split",
        "row_index",
        "category",
        "qa_index",
        get("question").alias("question"),
        answer.alias("answer"),
        get("options").alias("options_json"),
        "caption",
        image_list(F.coalesce(own, F.col("image_path"))).alias("images"),
        missing.alias("missing_fields"),
        "ord",
    )


def _answered() -> Column:
    return (F.size("missing_fields") == 0) & (F.trim("answer") != "")


def after(samples: DataFrame, row: int, category: str, index: int) -> DataFrame:
    """The samples behind a place, in the order of rows, ``TYPES`` and numbers: where an ingest goes on."""
    at = F.struct("row_index", "ord", "qa_index")
    return samples.filter(at > F.struct(F.lit(row).cast("long"), F.lit(TYPES.index(category)), F.lit(index)))


def complete(samples: DataFrame) -> DataFrame:
    """Samples with question and answer; options are put behind the question.  ``incomplete`` has the others."""
    asked = F.when(F.col("options_json").isNotNull(), F.concat("question", F.lit("\nOptions: "), "options_json")).otherwise(F.col("question"))
    return samples.filter(_answered()).withColumn("question", asked).withColumnRenamed("answer", "reference")


def incomplete(samples: DataFrame) -> DataFrame:
    """(split, id, missing_fields) of the samples that ``complete`` leaves out; count it to tell what is lost."""
    lost = F.when(F.size("missing_fields") > 0, F.col("missing_fields")).otherwise(F.array(F.lit("answer")))
    return samples.filter(~_answered()).select("split", "id", lost.alias("missing_fields"))


#: Blocks (a path and two numbers each) up to which their table is broadcast.
FEW_BLOCKS = 200_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines that aren't blank with their numbers from 1, from files of any size.

    Files are read in blocks, as Spark splits them.  A first pass counts the
    lines of each block; what lies before a block in its file is added to the
    places that its lines have within it.  Lines end with a line feed; a
    carriage return before it and a byte order mark don't count.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    blocks = settled(rows.groupBy("path", "block").agg(F.min("i").alias("first"), F.count("*").alias("n")))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("path", "block", (ahead - F.col("first")).alias("shift"))
    if blocks.count() <= FEW_BLOCKS:  # then no line moves
        blocks = F.broadcast(blocks)
    line = (F.col("i") + F.col("shift") + 1).cast("int")
    value = F.regexp_replace(F.when(line == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")), r"\r$", "")
    return rows.join(blocks, ["path", "block"]).select("file", line.alias("line"), value.alias("value")).filter(F.trim("value") != "")


def read_json_lines(spark: SparkSession, path: str, required: list[str] | dict[str, str], strict: bool = True, key: str | None = None) -> DataFrame:
    """(file, line, value) of JSON lines as variants.

    ``required`` names fields that must not be null, or gives the kind of each
    as ``schema_of_variant`` writes it (STRING, BIGINT, BOOLEAN, ...).  A line
    is one object and nothing else.  If ``strict``, a bad line, a repeated or
    empty value of ``key``, and an input without lines raise; else bad lines
    are left out.
    """
    rows = numbered_lines(spark, path)
    v = json_value(F.trim("value"))
    rows = rows.withColumn("v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))
    good = F.col("v").isNotNull()
    for name in required:
        kind = F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
        good = good & (F.coalesce(kind == required[name], F.lit(False)) if isinstance(required, dict) else F.coalesce(kind != "VOID", F.lit(False)))
    if not strict:
        return rows.filter(good).select("file", "line", F.col("v").alias("value"))
    if rows.isEmpty():
        raise ValueError(f"{path}: no lines")
    where = F.concat(F.lit("bad line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))
    out = rows.select("file", "line", F.when(good, F.col("v")).otherwise(F.raise_error(where).cast("variant")).alias("value"))
    if key:
        keys = out.groupBy(F.try_variant_get("value", f"$.{key}", "string").alias("key")).count()
        wrong = keys.filter("count > 1 or coalesce(trim(key), '') = ''").limit(5).collect()
        if wrong:
            raise ValueError(f"{path}: {key} repeated or empty: " + ", ".join(sorted(str(r["key"]) for r in wrong)))
    return out


def read_eval_samples(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(id, question, reference, images, question_type, options, answer) of evaluation samples.

    Ids are texts or whole numbers, which count as their text, and no two are
    equal; one that begins like a sample's id must have its form; question and reference are texts with something in them; images is
    a list of paths, none blank, which are placed in ``root`` if it is given.
    The last three may be missing: then they are null, else question_type is
    the text and the others are JSON.  All other fields are dropped; anything
    else raises with the line's number.
    """
    rows = read_json_lines(spark, path, ["id", "question", "reference", "images"])
    part = lambda n: F.try_variant_get("value", f"$.{n}", "variant")
    kind = lambda n: F.coalesce(F.schema_of_variant(part(n)), F.lit("VOID"))
    text = lambda n: F.try_variant_get("value", f"$.{n}", "string")
    said = lambda n: (kind(n) == "STRING") & (F.trim(text(n)) != "")
    each = F.try_variant_get("value", "$.images", "array<variant>")
    paths = F.transform(each, lambda x: F.try_variant_get(x, "$", "string"))
    listed = F.coalesce(kind("images").startswith("ARRAY") & F.forall(each, lambda x: (F.schema_of_variant(x) == "STRING") & (F.trim(F.try_variant_get(x, "$", "string")) != "")), F.lit(False))
    formed = ~F.trim(text("id")).startswith("mira:") | F.trim(text("id")).rlike(ID_FORM)
    wrong = F.concat_ws(", ", F.when(~((said("id") | (kind("id") == "BIGINT")) & formed), "id"), F.when(~said("question"), "question"), F.when(~said("reference"), "reference"), F.when(~listed, "images"))
    where = F.concat(F.lit("bad line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"), F.lit(": "), wrong)
    fine = rows.withColumn("value", F.when(wrong == "", F.col("value")).otherwise(F.raise_error(where).cast("variant")))
    json = lambda n: F.to_json(part(n))
    images = F.transform(paths, lambda x: placed(x, root)) if root else paths
    out = fine.select(F.trim(text("id")).alias("id"), text("question").alias("question"), text("reference").alias("reference"), images.alias("images"), text("question_type").alias("question_type"), json("options").alias("options"), json("answer").alias("answer"))
    twice = out.groupBy("id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{path}: id repeated: " + ", ".join(sorted(r["id"] for r in twice)))
    return out


GENERATIONS = "generations.jsonl"


def find_generations(spark: SparkSession, path: str) -> DataFrame:
    """(run, file) of the generation files that ``path`` stands for.

    ``path`` is such a file, in any case of letters, or a folder; a folder that
    holds one itself stands for it alone, else all below it count.  Files of
    other names, and folders without one, are refused.
    """
    if path.lower().endswith(".jsonl"):
        if path.rsplit("/", 1)[-1].lower() != GENERATIONS:
            raise ValueError(f"{path}: the file must be named {GENERATIONS}")
        files = spark.read.format("binaryFile").load(path)
    else:
        own = spark.read.option("pathGlobFilter", GENERATIONS).format("binaryFile")
        files = own.load(path)
        if files.select("path").isEmpty():
            files = own.option("recursiveFileLookup", True).load(path)
    files = files.select(F.col("path").alias("file"))
    if files.isEmpty():
        raise ValueError(f"{path}: no {GENERATIONS}")
    return files.select(F.regexp_replace("file", r"/[^/]*$", "").alias("run"), "file").orderBy("file")


def with_run_info(spark: SparkSession, generations: DataFrame, path: str) -> DataFrame:
    """``find_generations`` with the ``evaluation`` object of the summary.json beside each, as a variant; null where there is none."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").text(path, wholetext=True)
    info = found.select(F.regexp_replace("_metadata.file_path", r"/[^/]*$", "").alias("run"), F.try_variant_get(F.try_parse_json("value"), "$.evaluation", "variant").alias("evaluation"))
    local = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    return generations.withColumn("run", local("run")).join(info.withColumn("run", local("run")), "run", "left")


def indexed_ids(collections: DataFrame, segments: DataFrame, metadata: DataFrame, database: str, name: str) -> DataFrame:
    """(id) stored under one collection of an index: exactly one collection of that name and one metadata segment; ids distinct and not empty."""
    own = collections.filter((F.col("database") == database) & (F.col("name") == name))
    parts = segments.filter("scope = 'METADATA'").join(own.select(F.col("id").alias("collection")), "collection").select(F.col("id").alias("segment"))
    for what, df in (("collection", own), ("metadata segment", parts)):
        if (n := df.limit(2).count()) != 1:
            raise ValueError(f"{database}/{name}: {'no' if not n else 'more than one'} {what}")
    ids = metadata.join(parts, "segment").select(F.col("embedding_id").alias("id"))
    wrong = ids.groupBy("id").count().filter("count > 1 or coalesce(id, '') = ''").limit(1).collect()
    if wrong:
        raise ValueError(f"{database}/{name}: id repeated or empty: {wrong[0]['id']}")
    return ids


def read_manifest(spark: SparkSession, path: str, role: str = "test", required: tuple[str, ...] = (), formed: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """(role, ord, id) of a manifest: an object with train_ids and test_ids, or a bare list, which is of ``role``.

    Repeated ids, overlaps, ids of no known form in the ``formed`` roles and empty ``required`` roles raise.
    """
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    get = lambda p: F.try_variant_get("v", p, "array<string>")
    lists = F.array(*[F.struct(F.lit(r).alias("role"), ids.alias("ids")) for r, ids in (("train", get("$.train_ids")), ("test", get("$.test_ids")), (role, get("$")))])
    kind = F.schema_of_variant("v")
    fine = kind.startswith("ARRAY<") | (kind.startswith("OBJECT<") & (get("$.train_ids").isNotNull() | get("$.test_ids").isNotNull()))
    rows = doc.select(F.explode(F.when(F.coalesce(fine, F.lit(False)), lists).otherwise(F.raise_error(F.lit(f"{path}: no manifest")).cast("array<struct<role:string,ids:array<string>>>"))).alias("x")).select("x.role", F.posexplode("x.ids").alias("ord", "id"))
    for r in required:
        if rows.filter(F.col("role") == r).isEmpty():
            raise ValueError(f"{path}: no {r} ids")
    twice = rows.groupBy("id").count().filter("count > 1 or coalesce(trim(id), '') = ''").limit(5).collect()
    if twice:
        raise ValueError("ids given twice or empty: " + ", ".join(sorted(str(r["id"]) for r in twice)))
    wrong = rows.filter(F.col("role").isin(*formed) & F.col("id").startswith("mira:") & ~F.col("id").rlike(ID_FORM)).limit(5).collect()
    if wrong:
        raise ValueError("ids of no known form: " + ", ".join(sorted(r["id"] for r in wrong)))
    return rows


def read_keywords(spark: SparkSession, path: str) -> list[str]:
    """Keywords, one a line: comments and blank lines left out, the first of each in any case."""
    lines = [r["value"].lstrip("﻿") for r in spark.read.text(path).collect()]
    flat = [" ".join(x.split()) for x in lines]
    out = list({x.casefold(): x for x in reversed(flat) if x and not x.startswith("#")}.values())[::-1]
    if not out:
        raise ValueError(f"{path}: no keywords")
    return out


def resolve(wanted: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples of the wanted (ord, id) rows in that order; ``missing_ids`` tells which there aren't."""
    return samples.join(wanted.select("ord", "id"), "id").orderBy("ord")


def missing_ids(wanted: DataFrame, samples: DataFrame) -> DataFrame:
    return wanted.join(samples.select("id"), "id", "left_anti")


def chosen_samples(wanted: DataFrame, samples: DataFrame, incomplete_ones: str = "error") -> tuple[DataFrame, DataFrame]:
    """(samples, audit) of the wanted ids; those without question or answer raise, or with ``skip`` are left out and listed.

    Ids that are in no sample raise in either case.
    """
    lost = missing_ids(wanted, samples).limit(5).collect()
    if lost:
        raise ValueError("no such samples: " + ", ".join(sorted(r["id"] for r in lost)))
    own = samples.join(wanted.select("id"), "id", "left_semi")
    audit = incomplete(own)
    if incomplete_ones == "error" and (bad := audit.limit(5).collect()):
        raise ValueError("incomplete samples: " + ", ".join(sorted(r["id"] for r in bad)))
    return complete(own), audit

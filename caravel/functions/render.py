"""Samples, claims and reports as text, column by column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a question or answer that a source lacks; labels of a claim. Fixed values.
MISSING = "[not provided in source]"
LABELS = ("支持", "部分支持", "不支持")


def _filled(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).isin("", "{}", "[]"), F.lit(MISSING)).otherwise(text)


def question_text(question: Column, options: Column | None = None) -> Column:
    """The question, and its options (JSON) on a line of their own; a placeholder for a missing question."""
    options = F.lit(None).cast("string") if options is None else F.when(options.isin("", "{}", "[]"), F.lit(None)).otherwise(options)
    return F.concat(_filled(question), F.coalesce(F.concat(F.lit("\nOptions: "), options), F.lit("")))


def answer_text(answer: Column) -> Column:
    """The answer or a placeholder."""
    return _filled(answer)


def sample_document(question: Column, answer: Column, options: Column | None = None, extra: Column | None = None, caption: Column | None = None) -> Column:
    """A sample as indexed: question, options, answer, further fields and caption, a line each; what is null is left out."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    parts = [line("Question", question_text(question, options)), line("Answer", answer_text(answer))]
    for name, c in (("Additional fields", extra), ("Caption", caption)):
        if c is not None:
            parts.append(line(name, F.when(c.isin("", "{}"), F.lit(None)).otherwise(c)))
    return F.concat_ws("\n", *parts)


def query_document(question: Column) -> Column:
    """A sample as asked: like ``sample_document`` with the placeholder for its answer, so that no answer leaks into a search."""
    return sample_document(question, F.lit(None).cast("string"))


def provenance(split: Column, row: Column, category: Column, index: Column, images: Column, caption: Column, missing: Column) -> Column:
    """Where a sample comes from: 11 fields for an index's metadata."""
    return F.struct(
        split.alias("split"),
        F.concat(split, F.lit(".csv")).alias("source_csv"),
        row.alias("source_row"),
        category.alias("category"),
        index.alias("qa_index"),
        F.to_json(images).alias("image_paths"),
        F.size(images).alias("image_count"),
        caption.alias("caption"),
        (~F.array_contains(missing, "question")).alias("has_question"),
        (~F.array_contains(missing, "answer")).alias("has_answer"),
        F.to_json(missing).alias("missing_fields"),
    )


def canonical_key(value: Column) -> Column:
    """An id of a variant as text: a whole number equals its digits; booleans, other kinds and empty texts are errors."""
    kind = F.schema_of_variant(value)
    text = F.trim(F.try_variant_get(value, "$", "string"))
    return F.when(kind.isin("STRING", "BIGINT") & (text != ""), text).otherwise(F.raise_error(F.lit("an id is a text or a whole number")).cast("string"))


def row_key(source: Column, index: Column) -> Column:
    """source:index, the index from 1 over all rows seen."""
    return F.concat_ws(":", source, index.cast("string"))


def percent(value: Column, digits: int = 2) -> Column:
    """A share times 100; null stays null."""
    return F.round(value * 100, digits)


def compact_json(*columns: Column) -> Column:
    """The columns as JSON in their order, nulls too."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def lines_of(value: Column) -> Column:
    """A variant as text: nothing for null, a line for each element of a list, JSON for an object."""
    kind = F.schema_of_variant(value)
    own = F.try_variant_get(value, "$", "string")
    listed = F.array_join(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))), "\n")
    return F.coalesce(F.when(kind.startswith("ARRAY"), listed).otherwise(own), F.lit(""))


def shortened(text: Column, limit: int) -> Column:
    """The first ``limit`` characters and how many are left out; 0 for no limit."""
    if not limit:
        return text
    more = F.char_length(text) - limit
    return F.when(more > 0, F.concat(F.substring(text, 1, limit), F.lit("\n... ["), more.cast("string"), F.lit(" characters left out]"))).otherwise(text)


def support_label(raw: Column) -> tuple[Column, Column]:
    """(label, valid): one of ``LABELS`` as a whole answer but for signs around it; anything else counts as the last and isn't valid."""
    label = F.btrim(raw, F.lit(" \t\r\n。.!！\'\"“”"))
    valid = F.coalesce(label.isin(*LABELS), F.lit(False))
    return F.when(valid, label).otherwise(LABELS[-1]), valid


def fact_sources(reference: Column, evidence: Column, kind: str) -> Column:
    """(source, text) of what claims are checked against; ``evidence``: an array of (id, question, reference)."""
    if kind not in ("reference", "evidence", "both"):
        raise ValueError(kind)
    one = F.struct(F.lit("reference").alias("source"), reference.alias("text"))
    none = F.array().cast("array<struct<source:string,text:string>>")
    own = F.when(F.trim(F.coalesce(reference, F.lit(""))) != "", F.array(one)).otherwise(none)
    found = F.transform(evidence, lambda e: F.struct(F.concat(F.lit("evidence:"), e["id"].cast("string")).alias("source"), F.concat(F.lit("问题："), e["question"], F.lit("\n答案："), e["reference"]).alias("text")))
    return {"reference": own, "evidence": F.coalesce(found, none), "both": F.concat(own, F.coalesce(found, none))}[kind]


def claim_lines(claims: Column) -> Column:
    """Numbered lines of claims (claim, label, score, valid); a note where there are none."""
    rows = F.transform(claims, lambda c, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". ["), c["label"], F.lit("]"), F.when(c["valid"], "").otherwise(" [unread]"), F.lit(" "), c["claim"], F.lit(" (score="), c["score"].cast("string"), F.lit(")")))
    return F.when(F.coalesce(F.size(claims), F.lit(0)) > 0, F.array_join(rows, "\n")).otherwise("  (no claims)")


def text_lengths(**fields: Column) -> Column:
    """How many characters each field has."""
    return F.struct(*[F.coalesce(F.char_length(c), F.lit(0)).alias(n) for n, c in fields.items()])


#: Names that some systems reserve for devices. Fixed values.
DEVICES = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def safe_name(name: str, limit: int = 80) -> str:
    """``name`` if it can be a file's name anywhere: word characters, dots, hyphens; else ValueError."""
    if not re.fullmatch(r"[^\W_][\w.\-]*", name) or name.endswith(".") or len(name) > limit or name.split(".")[0].lower() in DEVICES:
        raise ValueError(f"no safe name: {name!r}")
    return name

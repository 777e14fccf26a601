"""Fields of free-text and JSON reports."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def labelled(parts: dict[str, Column], colon: str = "：") -> Column:
    """Lines ``label：value`` of the parts that say something, in order."""
    return F.concat_ws("\n", *[F.when(F.trim(c) != "", F.concat(F.lit(n + colon), F.trim(c))) for n, c in parts.items()])


def section(text: Column, label: str, headings: list[str]) -> Column:
    """What stands behind ``label：`` up to the next known heading; empty if nothing does."""
    stop = "|".join(re.escape(h) for h in headings)
    return F.trim(F.regexp_extract(text, rf"(?s){re.escape(label)}\s*[:：]\s*(.*?)(?=(?:\n|^)\s*(?:{stop})\s*[:：]|\z)", 1))


def items(text: Column) -> Column:
    """Parts between newlines, semicolons and commas, without bullets and blanks."""
    parts = F.transform(F.split(text, "[\n；;、，,]"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*•·\d.)）]+", "")))
    return F.filter(parts, lambda x: x != "")


def unwrapped(value: Column, wrappers: tuple[str, ...] = ("data", "result", "delta")) -> Column:
    """A variant object out of the first wrapper that it has."""
    out = value
    for w in reversed(wrappers):
        inner = F.try_variant_get(value, f"$.{w}", "variant")
        out = F.when(F.coalesce(F.schema_of_variant(inner).startswith("OBJECT"), F.lit(False)), inner).otherwise(out)
    return out


def field(value: Column, *aliases: str) -> Column:
    """The first alias that is present, as text, be it empty."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{a}", "string") for a in aliases])


def merged(old: Column, new: Column) -> Column:
    """The later value unless it is blank."""
    return F.coalesce(F.when(F.trim(new) != "", new), old)


def with_notice(text: Column, notice: str, default: str) -> Column:
    """The text, or a default for a blank one, that ends with a notice once."""
    said = F.coalesce(F.when(F.trim(text) != "", text), F.lit(default))
    return F.when(said.contains(notice), said).otherwise(F.concat(said, F.lit(notice)))


def json_objects(text: str) -> list[str]:
    """JSON objects in a text, outermost first found, wherever they stand."""
    out, at, reader = [], 0, json.JSONDecoder()
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = reader.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        out.append(json.dumps(value, ensure_ascii=False))
        at = end
    return list(dict.fromkeys(out))


@F.pandas_udf(T.ArrayType(T.StringType()))
def objects_in(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [] if t is None else json_objects(t))


#: Clues looked for in case texts, and conclusions by clue, first match first. Fixed values.
CLUES = ("高血压", "LDL-C", "ST-T", "冠脉", "钙化斑块", "胸痛", "胸闷", "气短")
CONCLUSIONS = (
    (("冠脉", "冠心病", "ST-T", "胸痛", "LDL-C"), "疑似冠心病或冠状动脉粥样硬化相关风险，需进一步临床评估。"),
    (("呼吸困难", "水肿", "BNP", "EF"), "疑似心功能异常相关风险，需进一步临床评估。"),
)
OPEN_CASE = "心血管相关症状或危险因素待评估。"
NO_FINDINGS = "模型未返回标准关键发现，需结合原始病例材料复核。"
FIELDS = {"diagnosis": ("综合诊断结果", "综合诊断", "诊断结果"), "findings": ("关键发现",), "analysis": ("AI分析", "AI 分析"), "advice": ("临床建议",)}


def summary_by_rule(profile: dict[str, Column], symptoms: Column, exams: Column, more: Column, most: int = 8) -> tuple[Column, Column]:
    """(diagnosis, findings) from the inputs alone: profile, symptoms, lines of exams, clues not said yet; ``most`` findings."""
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    own = F.concat_ws("；", *[F.when(said(c) != "", F.concat(F.lit(f"{n} " if n else ""), said(c))) for n, c in profile.items()])
    every = F.concat_ws("\n", *[said(c) for c in profile.values()], said(symptoms), said(exams), said(more))
    found = F.concat(
        F.when(own != "", F.array(F.concat(F.lit("患者信息："), own))).otherwise(F.array().cast("array<string>")),
        F.transform(items(said(symptoms)), lambda x: F.concat(F.lit("症状："), x)),
        F.transform(F.filter(F.transform(F.split(said(exams), "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.concat(F.lit("检查："), x)),
    )
    clue_of = lambda f, c: F.when(every.contains(c) & ~F.exists(f, lambda x: x.contains(c)), F.concat(f, F.array(F.concat(F.lit("相关线索："), c)))).otherwise(f)
    found = F.aggregate(F.array(*[F.lit(c) for c in CLUES]), found, clue_of)
    diagnosis = F.lit(OPEN_CASE)
    for clues, text in reversed(CONCLUSIONS):
        diagnosis = F.when(F.exists(F.array(*[F.lit(c) for c in clues]), lambda c: every.contains(c)), text).otherwise(diagnosis)
    return diagnosis, F.when(F.size(found) > 0, F.array_join(F.slice(found, 1, most), "\n")).otherwise(NO_FINDINGS)


def report_of(text: Column, fallback: dict[str, Column]) -> Column:
    """The four fields of an answer: of the first JSON object in it that has any, else its headed sections, else the fallback's."""
    heads = [h for names in FIELDS.values() for h in names]
    empty = lambda c: F.coalesce(F.trim(c), F.lit(""))

    def some(report: Column) -> Column:
        out = F.lit(False)
        for n in FIELDS:
            out = out | (report[n] != "")
        return out

    parsed = F.transform(objects_in(text), lambda j: unwrapped(F.try_parse_json(j)))
    reports = F.transform(parsed, lambda v: F.struct(*[empty(field(v, n)).alias(n) for n in FIELDS]))
    from_json = F.get(F.filter(reports, some), F.lit(0))
    headed = F.struct(*[F.coalesce(*[F.nullif(section(text, h, heads), F.lit("")) for h in names], F.lit("")).alias(n) for n, names in FIELDS.items()])
    rest = F.struct(*[empty(fallback.get(n, F.lit(""))).alias(n) for n in FIELDS])
    return F.coalesce(from_json, F.when(some(headed), headed), rest)


def events_of(stream: Column) -> Column:
    """The distinct payloads of a server's event stream: its data lines but the closing mark, and JSON objects in other text."""
    lines = F.transform(F.split(stream, "\r?\n"), lambda x: F.trim(x))
    data = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 2**31 - 1))), lambda x: ~x.isin("", "[DONE]"))
    other = F.array_join(F.filter(lines, lambda x: ~x.startswith("data:")), "\n")
    return F.array_distinct(F.concat(data, objects_in(other)))


def folded(payloads: Column) -> Column:
    """One report of many payloads (JSON texts): of each field the last text that isn't blank."""
    texts = lambda v: F.struct(*[F.coalesce(field(v, n), F.lit("")).alias(n) for n in FIELDS])
    last = lambda said, n: F.coalesce(F.try_element_at(F.filter(F.transform(said, lambda t: t[n]), lambda t: F.trim(t) != ""), F.lit(-1)), F.lit(""))
    # each step is the element of an array, so that it is worked out once, not once for every place that names it
    said = F.transform(F.transform(F.transform(payloads, lambda p: F.try_parse_json(p)), lambda v: unwrapped(v)), texts)
    return F.get(F.transform(F.array(said), lambda x: F.struct(*[last(x, n).alias(n) for n in FIELDS])), F.lit(0))

"""Column functions over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[㐀-䶿一-鿿豈-﫿]"
#: Names of roles in chat data, and what they stand for. Fixed values.
ROLES = {"human": "user", "user": "user", "患者": "user", "病人": "user", "gpt": "assistant", "assistant": "assistant", "doctor": "assistant", "医生": "assistant", "system": "system"}


def url_only(text: Column) -> Column:
    """Whether the whole text is one link."""
    return F.coalesce(F.trim(text).rlike(r"(?i)^https?://\S+$"), F.lit(False))


def estimated_tokens(text: Column) -> Column:
    """One for each CJK character and a quarter, rounded up, for the others; 0 only for an empty text."""
    text = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(text, F.lit(CJK))
    other = F.char_length(text) - cjk
    return F.when(F.char_length(text) == 0, 0).otherwise(F.greatest(F.lit(1), cjk + F.ceil(other / 4))).cast("long")


def token_budget(tokens: Column, multiplier: float, extra: int, least: int, most: int) -> Column:
    """ceil(tokens * multiplier) + extra, at least ``least`` and at most ``most``."""
    large = tokens >= most / multiplier
    return F.when(large, most).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(tokens * multiplier) + extra))).cast("long")


def neutral_formula(text: Column) -> Column:
    """Text that a spreadsheet won't run: an apostrophe is put before one that, white space aside, begins with = + - or @."""
    return F.when(text.rlike(r"(?U)^\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def chunks(text: Column, size: int) -> Column:
    """The text in parts of ``size`` characters; one empty part for an empty text."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.char_length(text) - 1), F.lit(size))
    return F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size)))


def preview(text: Column, limit: int = 220) -> Column:
    """White space collapsed, cut to ``limit`` characters and three dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def role_name(role: Column) -> Column:
    """user, assistant or system for the known names; others lower-cased as they are."""
    key = F.lower(F.trim(role))
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(known[key], key)


def first_text(*columns: Column) -> Column:
    """The first of the columns that isn't blank, trimmed; else an empty text."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def first_present(*columns: Column) -> Column:
    """The first of the columns that is there, be it blank."""
    return F.coalesce(*columns)


def json_value(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else; null for any other."""
    # the parser stops behind the first value; within brackets of both kinds more text is an error
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    other = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.when((F.size(one) == 1) & other.isNotNull(), F.get(one, F.lit(0)))


def without_thinking(text: Column) -> Column:
    """Text without complete think blocks; null if a tag is left over or nothing else is said."""
    rest = F.trim(F.regexp_replace(text, r"(?is)<think\b[^>]*>.*?</think\s*>", ""))
    return F.when(rest.rlike(r"(?i)</?think\b") | (rest == ""), F.lit(None)).otherwise(rest)


def final_text(text: Column) -> Column:
    """Text without complete think blocks, cut where an open one begins."""
    rest = F.regexp_replace(text, r"(?is)<think\b[^>]*>.*?</think\s*>", "")
    return F.trim(F.element_at(F.split(rest, r"(?i)<think\b"), 1))


def after_thinking(text: Column) -> Column:
    """What follows the last closing think tag."""
    return F.regexp_replace(text, r"(?s)^.*</think>\s*", "")


def masked_key(key: Column) -> Column:
    """A secret shown by its ends only; words for one that is missing or too short for that."""
    return F.when(F.coalesce(key, F.lit("")) == "", "<empty>").when(F.char_length(key) <= 8, "<set>").otherwise(F.concat(F.substring(key, 1, 4), F.lit("..."), F.substr(key, F.char_length(key) - 3, F.lit(4))))


def shifted_tail(key: Column, by: int) -> Column:
    """An id of three parts or more with ``by`` added to the number that ends it; others stay."""
    tail = F.regexp_extract(key, r"^(?s)(.*:[^:]*):\s*([+-]?[0-9]+)\s*$", 2).try_cast("long")
    return F.when(tail.isNotNull(), F.concat(F.regexp_extract(key, r"^(?s)(.*:[^:]*):\s*([+-]?[0-9]+)\s*$", 1), F.lit(":"), (tail + by).cast("string"))).otherwise(key)


def key_forms(key: Column, prefix: str = "") -> dict[str, Column]:
    """The ways in which an index may write an id, in the order in which they are tried."""
    led = lambda c: F.concat(F.lit(prefix), c)
    before, behind = shifted_tail(key, -1), shifted_tail(key, 1)
    return {"as_is": key, "prefix": led(key), "bare": F.regexp_replace(key, "^mira:", ""), "prefix_previous": led(before), "previous": before, "prefix_next": led(behind), "next": behind}


def fingerprint(*columns: Column) -> Column:
    """sha256 of the values as text, joined by a unit separator; a null differs from an empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def sample_id(split: Column, row: Column, category: Column, index: Column) -> Column:
    return F.concat_ws(":", F.lit("mira"), split, row.cast("string"), category, index.cast("string"))


#: Form of a sample's id. Fixed values.
ID_FORM = r"^mira:(train|validation|test):([0-9]+):(open_ended|closed_ended|single_choice|multiple_choice):([0-9]+)$"


def parsed_id(text: Column) -> Column:
    """(split, row, category, index) of a sample's id; null if it hasn't the form."""
    part = lambda i: F.regexp_extract(text, ID_FORM, i)
    return F.when(text.rlike(ID_FORM), F.struct(part(1).alias("split"), part(2).cast("long").alias("row"), part(3).alias("category"), part(4).cast("int").alias("index")))


#: A token budget's settings and what they are if nothing is said. Fixed values.
BUDGET = {"enabled": False, "multiplier": 4.0, "extra": 256, "least": 512, "most": 4096, "retry": True}
#: The same for answers that list facts. Fixed values.
FACT_BUDGET = {"enabled": False, "multiplier": 2.0, "extra": 256, "least": 1024, "most": 8192, "retry": True}
#: Bounds of the multiplier and of numbers of tokens. Fixed values.
MOST_MULTIPLIER, MOST_TOKENS = 32, 32_768


def budget_policy(defaults: dict | None = None, **given) -> dict:
    """``BUDGET`` (or ``defaults``) with the given settings; unknown names, wrong kinds, what passes the bounds and a least above the most are refused."""
    unknown = (set(defaults or {}) | set(given)) - set(BUDGET)
    if unknown:
        raise ValueError("no such setting: " + ", ".join(sorted(unknown)))
    out = BUDGET | (defaults or {}) | given
    if any(type(out[n]) is not bool for n in ("enabled", "retry")):
        raise ValueError("enabled and retry are true or false")
    if type(out["multiplier"]) not in (int, float) or not 0 < out["multiplier"] <= MOST_MULTIPLIER:
        raise ValueError(f"the multiplier is above 0 and at most {MOST_MULTIPLIER}")
    if any(type(out[n]) is not int or not low <= out[n] <= MOST_TOKENS for n, low in (("extra", 0), ("least", 1), ("most", 1))):
        raise ValueError(f"numbers of tokens are whole, at most {MOST_TOKENS}, and but for extra at least 1")
    if out["least"] > out["most"]:
        raise ValueError("least is at most most")
    return out

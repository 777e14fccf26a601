"""Chat formatting: layouts told apart by their field paths, turns, template and loss mask.

DataFrame functions only.  Of an object those nested field paths count that
some layout names; their hash is its fingerprint, which selects a declarative
mapping to canonical turns.  Other fields are ignored.  A fingerprint that no
layout has gives null turns; ``unknown_layouts`` counts these rows by layout.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, ESCAPE = "<|im_start|>", "<|im_end|>\n", "\\"
TURNS = "array<struct<role:string,text:string>>"
RENAME = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How to read turns from one layout; all paths are dotted, to any depth.

    Either ``turns`` names an array of messages with ``role`` and ``text``
    paths inside each, or ``fields`` lists (role, paths) pairs: the texts of a
    pair that aren't empty are joined by a blank line into one turn.  Paths in
    ``optional`` may be missing; a pair of which all are missing gives no turn.
    """

    name: str
    turns: str = ""
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        """The paths that it names; those behind ``[]`` are inside an array's elements."""
        if self.turns:
            return [f"{self.turns}[]", f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]
        return [n for _, names in self.fields for n in names]

    def shapes(self) -> list[tuple[str, ...]]:
        """The sets of paths that it reads: an empty array has no elements, optional paths may be missing."""
        own = self.paths()
        if self.turns:
            return [tuple(own[:1]), tuple(own)]
        return [tuple(n for n in own if n not in gone) for size in range(len(self.optional) + 1) for gone in combinations(self.optional, size)]


def _pair(name: str, asks: tuple[str, ...], says: str, *optional: str) -> Layout:
    return Layout(name, fields=(("system", ("system",)), ("user", asks), ("assistant", (says,))), optional=("system", *optional))


LAYOUTS = (
    Layout("messages", turns="messages"),
    Layout("sharegpt", turns="conversations", role="from", text="value", rename=RENAME),
    Layout("dialog", turns="dialog", role="speaker", text="utterance", rename=RENAME),
    Layout("nested", turns="data.thread.turns", role="author.role", text="body.text"),
    _pair("instruction", ("instruction", "input"), "output", "input"),
    _pair("completion", ("prompt",), "completion"),
    _pair("response", ("prompt",), "response"),
    _pair("question", ("question",), "answer"),
)


def fingerprint(paths) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()[:16]


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, "$." + path, kind)


def _there(value: Column, path: str) -> Column:
    """Whether a variant has a path: an array for ``[]``, else a value that is no object and no array, or JSON null."""
    array, _, inner = path.partition("[]")
    if inner:
        return F.coalesce(F.exists(_at(value, array, "array<variant>"), lambda x: _there(x, inner[1:])), F.lit(False))
    if array != path:
        return _at(value, array, "array<variant>").isNotNull()
    return F.coalesce(~F.schema_of_variant(_at(value, path)).rlike("^(OBJECT|ARRAY)"), F.lit(False))


def named_paths(value: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The sorted paths of a variant that layouts name, joined by commas."""
    names = sorted({p for x in layouts for p in x.paths()})
    return F.array_join(F.array_compact(F.array(*[F.when(_there(value, p), F.lit(p)) for p in names])), ",")


def layout_of(value: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The name of the layout that a variant's fingerprint selects; null if none has it."""
    table: dict[str, str] = {}
    for x in layouts:
        for shape in x.shapes():
            if table.setdefault(fingerprint(shape), x.name) != x.name:
                raise ValueError(f"{x.name} and {table[fingerprint(shape)]} have the paths {shape}")
    key = F.substring(F.sha2(named_paths(value, layouts), 256), 1, 16)
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


def _turns(value: Column, x: Layout) -> Column:
    if x.turns:
        name = lambda m: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in x.rename.items() for v in kv]), F.lower(m)), m) if x.rename else m
        return F.transform(_at(value, x.turns, "array<variant>"), lambda m: F.struct(name(_at(m, x.role, "string")).alias("role"), F.coalesce(_at(m, x.text, "string"), F.lit("")).alias("text")))
    turns = []
    for role, names in x.fields:
        texts = F.filter(F.array(*[_at(value, n, "string") for n in names]), lambda t: F.length(t) > 0)
        turn = F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text"))
        there = F.lit(False)
        for n in names:
            there = there | _there(value, n)
        turns.append(F.when(there, turn) if set(names) <= set(x.optional) else turn)
    return F.array_compact(F.array(*turns)).cast(TURNS)


def canonical_turns(value: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Turns (role, text) of a variant by the layout of its fingerprint; null if none is known.

    Null texts are empty, null roles stay null, roles are renamed by the
    layout.  Objects may hold more fields, elements of arrays too; an element
    without a role or text has a null role or an empty text.
    """
    name = layout_of(value, layouts)
    out = F.lit(None).cast(TURNS)
    for x in layouts:
        out = F.when(name == x.name, _turns(value, x)).otherwise(out)
    return out


def unknown_layouts(df: DataFrame, value: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(layout, n): how many rows have each whole layout, as ``schema_of_variant`` writes it, that no mapping reads; null variants too."""
    return df.filter(layout_of(F.col(value), layouts).isNull()).groupBy(F.schema_of_variant(value).alias("layout")).agg(F.count("*").alias("n"))


def in_layout(turns: Column, x: Layout) -> Column:
    """Turns as a variant of a layout of messages, such that ``canonical_turns`` gives them back.

    Roles that the layout renames are written by its first name for them.
    """
    back = {v: k for k, v in reversed(x.rename.items())}
    name = (lambda r: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in back.items() for v in kv]), r), r)) if back else (lambda r: r)

    def nest(path: str, own: Column) -> Column:
        first, _, rest = path.partition(".")
        return (nest(rest, own) if rest else own).alias(first) if not rest else F.struct(nest(rest, own)).alias(first)

    return F.to_variant_object(F.struct(nest(x.turns, F.transform(turns, lambda t: F.struct(nest(x.role, name(t["role"])), nest(x.text, t["text"]))))))


#: Tables with a row for each turn: (conversation, turn, role, text), the first whose columns are there.
TURN_TABLES = (
    ("conv_id", "turn", "role", "text"),
    ("conversation_id", "position", "role", "content"),
    ("thread", "index", "speaker", "utterance"),
)


def turn_columns(df: DataFrame) -> tuple[str, str, str, str]:
    """The names that a turn table has; extra columns don't count."""
    for columns in TURN_TABLES:
        if set(columns) <= set(df.columns):
            return columns
    raise ValueError(f"no turn table: {', '.join(df.columns)}")


def conversations(df: DataFrame) -> DataFrame:
    """(conversation, turns) of a table with a row for each turn.

    Turns come in the order of their number (nulls first), role and text;
    repeated rows stay repeated; a null role or text is empty.  A row without a
    conversation's id is a conversation of its own, so that no group of them
    grows with the table.
    """
    conv, turn, role, text = turn_columns(df)
    own = F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("_own")
    rows = df.select(F.col(conv).alias("conversation"), own, F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"))
    made = rows.groupBy("conversation", "_own").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return made.select("conversation", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def escape(text: Column) -> Column:
    """Text in which the template's marks can't be spelled; ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit("<|"), F.lit("<" + ESCAPE + "|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<" + ESCAPE + "|"), F.lit("<|")), F.lit(ESCAPE * 2), F.lit(ESCAPE))


def _head(role: Column) -> Column:
    # roles are written as in URLs, so that they hold no newline and no mark
    return F.concat(F.lit(START), F.url_encode(F.coalesce(role, F.lit(""))), F.lit("\n"))


def format_array(turns: Column) -> Column:
    """(formatted, loss_mask) of an array of turns; null for null turns.

    ``loss_mask`` has (start, length), in characters of ``formatted``, of the assistant's texts.
    """
    pieces = F.transform(turns, lambda t: F.struct(_head(t["role"]).alias("head"), escape(F.coalesce(t["text"], F.lit(""))).alias("body"), (F.coalesce(t["role"], F.lit("")) == "assistant").alias("loss")))
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    span = lambda s, p: F.struct((s["at"] + F.char_length(p["head"])).alias("start"), F.char_length(p["body"]).cast("long").alias("length"))
    mask = F.aggregate(
        pieces,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("mask")),
        lambda s, p: F.struct((s["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + len(END)).alias("at"), F.when(p["loss"], F.concat(s["mask"], F.array(span(s, p)))).otherwise(s["mask"]).alias("mask")),
        lambda s: s["mask"],
    )
    return F.when(turns.isNotNull(), F.struct(text.alias("formatted"), mask.alias("loss_mask")))


def format_turns(df: DataFrame) -> DataFrame:
    """(conversation, formatted, loss_mask) of a table with a row for each turn; see ``conversations`` and ``format_array``."""
    return conversations(df).select("conversation", format_array(F.col("turns")).alias("f")).select("conversation", "f.*")


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    chunks = F.filter(F.split(formatted, re.escape(START)), lambda c: F.length(c) > 0)
    head = lambda c: F.substring_index(c, "\n", 1)
    body = lambda c: F.substr(c, F.char_length(head(c)) + 2, F.char_length(c) - F.char_length(head(c)) - 1 - len(END))
    return F.transform(chunks, lambda c: F.struct(F.url_decode(head(c)).alias("role"), unescape(body(c)).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")

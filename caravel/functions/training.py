"""Columns for supervised fine-tuning data: layouts to messages, masks, padding, samples of positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caravel.functions.text import first_text

#: Label of a position that a loss leaves out. Fixed value.
IGNORED = -100


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def three_messages(system: str, question: Column, answer: Column) -> Column:
    """system, user, assistant; null unless question and answer say something."""
    full = (first_text(question) != "") & (first_text(answer) != "")
    return F.when(full, F.array(message("system", F.lit(system)), message("user", F.trim(question)), message("assistant", F.trim(answer))))


def from_instruction(system: str, instruction: Column, extra: Column, output: Column) -> Column:
    """Instruction and input, joined by a blank line, asked; output answered."""
    asked = F.concat_ws("\n\n", F.nullif(first_text(instruction), F.lit("")), F.nullif(first_text(extra), F.lit("")))
    return three_messages(system, asked, output)


def from_reasoned(system: str, question: Column, thought: Column, response: Column, keep_thought: bool) -> Column:
    """Question and response, with the thought in think tags before it if asked for."""
    told = F.when((first_text(thought) != "") & F.lit(keep_thought), F.concat(F.lit("<think>\n"), F.trim(thought), F.lit("\n</think>\n"), F.trim(response))).otherwise(response)
    return F.when(first_text(response) != "", three_messages(system, question, told))


def first_known(*messages: Column) -> Column:
    """The first layout that gave messages."""
    return F.coalesce(*messages)


def rendered(messages: Column) -> Column:
    """``role: content`` lines."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def answered(messages: Column, question: Column, answer: Column) -> Column:
    """Messages that end with an assistant, else built from question and answer, else null."""
    clean = F.filter(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "")
    good = F.coalesce(F.get(F.reverse(clean), F.lit(0))["role"] == "assistant", F.lit(False))
    built = F.when((first_text(question) != "") & (first_text(answer) != ""), F.array(message("user", question), message("assistant", answer)))
    return F.when(good, clean).otherwise(built)


def labels(ids: Column, prompt: Column) -> Column:
    """Token ids with the first ``prompt`` of them ignored."""
    return F.transform(ids, lambda x, i: F.when(i < prompt, IGNORED).otherwise(x))


def padded(values: Column, length: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), (length - F.size(values)).cast("int")))


def token_accuracy(predicted: Column, wanted: Column) -> Column:
    """Share of the positions that count which are right; null if none counts."""
    pairs = F.filter(F.arrays_zip(predicted.alias("p"), wanted.alias("w")), lambda x: x["w"] != IGNORED)
    return F.when(F.size(pairs) > 0, F.size(F.filter(pairs, lambda x: x["p"] == x["w"])) / F.size(pairs))


def spread(values: Column, count: int) -> Column:
    """``count`` values at even distances from first to last; the last again if there are too few."""
    n = F.size(values)
    even = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.get(values, F.floor(i * (n - 1) / F.lit(max(1, count - 1))).cast("int")))
    short = F.concat(values, F.array_repeat(F.get(values, n - 1), F.greatest(F.lit(0), count - n)))
    return F.when(n <= count, short).otherwise(even)


def cut_but_special(ids: Column, special: list[int], length: int) -> Column:
    """All special ids and the first others, ``length`` in all at most where specials allow."""
    is_special = lambda x: x.isin(*special)
    room = F.greatest(F.lit(0), F.lit(length) - F.size(F.filter(ids, is_special)))
    places = F.filter(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: ~is_special(F.get(ids, i)))
    last = F.coalesce(F.get(places, room), F.lit(2**31 - 1))
    return F.when(F.size(ids) <= length, ids).otherwise(F.filter(ids, lambda x, i: is_special(x) | (i < last)))


def closed_instruction(text: Column) -> Column:
    """An instruction that ends with a punctuation mark."""
    flat = F.trim(text)
    return F.when(flat.rlike(r"\p{P}$"), flat).otherwise(F.concat(flat, F.lit(".")))


def limit_reached(ids: Column, limit: Column, ends: list[int]) -> Column:
    """Whether generation stopped for its length alone."""
    return (F.size(ids) >= limit) & ~F.coalesce(F.get(F.reverse(ids), F.lit(0)).isin(*ends), F.lit(False))


def supervised_row(prompt: Column, answer: Column, length: int, longer: str = "error") -> Column:
    """(ids, labels, answer_tokens, truncated) of prompt and answer ids; ids of the prompt are ignored.

    Rows over ``length`` ids raise, are ``cut`` at the end, or with ``skip``
    are null; a row in which no id of the answer is left is null.
    """
    if longer not in ("error", "cut", "skip"):
        raise ValueError(longer)
    whole = F.concat(prompt, answer)
    over = F.size(whole) > length
    ids = F.slice(whole, 1, length)
    left = F.greatest(F.size(ids) - F.size(prompt), F.lit(0))
    row = F.struct(ids.alias("ids"), labels(ids, F.size(prompt)).alias("labels"), left.alias("answer_tokens"), over.alias("truncated"))
    fine = F.when(left > 0, row)
    if longer == "cut":
        return fine
    lost = F.raise_error(F.concat(F.lit("a row has more than "), F.lit(str(length)), F.lit(" tokens"))).cast("int") if longer == "error" else F.lit(None).cast("int")
    return F.when(over & (F.coalesce(lost, F.lit(0)) == 0), F.lit(None)).otherwise(fine)


def by_hint(hint: Column, layouts: dict[str, Column]) -> Column:
    """Messages by the layout that a hint names; the first that gives any for ``auto`` or no hint; null for an unknown one."""
    out = F.when(F.coalesce(hint, F.lit("auto")) == "auto", first_known(*layouts.values()))
    for name, messages in layouts.items():
        out = out.when(hint == name, messages)
    return out

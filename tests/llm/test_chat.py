import hashlib
import json

import pytest
from pyspark.sql import functions as F

from caravel.llm import chat

SAME = [("user", "hi"), ("assistant", "yo")]
LAYOUTS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, SAME),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, SAME),
    ({"dialog": [{"speaker": "user", "utterance": "hi"}, {"speaker": "bot", "utterance": "yo"}]}, SAME),
    ({"instruction": "hi", "input": "", "output": "yo"}, SAME),
    ({"instruction": "a", "input": "b", "output": "yo"}, [("user", "a\n\nb"), ("assistant", "yo")]),
    ({"instruction": "hi", "output": "yo"}, SAME),
    ({"prompt": "hi", "completion": "yo"}, SAME),
    ({"response": "yo", "prompt": "hi"}, SAME),
    ({"question": "hi", "answer": "yo"}, SAME),
    ({"system": "s", "prompt": "hi", "response": None}, [("system", "s"), ("user", "hi"), ("assistant", "")]),
    ({"odd": 1}, None),
    ({"messages": "text"}, None),
    ({"prompt": {"x": 1}, "response": "yo"}, None),
    ({"prompt": "a", "messages": []}, None),
    ({"messages": []}, []),
    ({"id": 7, "source": {"deep": {"deeper": [{"x": [1]}]}}, "messages": [{"role": "user", "content": "hi", "name": "n"}, {"role": "assistant", "content": "yo", "meta": {"a": {"b": {"c": {"d": 1}}}}}]}, SAME),
    ({"messages": [{"role": "gpt", "content": None}, {"content": "x"}]}, [("gpt", ""), (None, "x")]),
    ({"data": {"thread": {"turns": [{"author": {"role": "user"}, "body": {"text": "hi"}}, {"author": {"role": "assistant", "id": 1}, "body": {"text": "yo"}}]}}}, SAME),
    (None, None),
]


def test_layouts(spark):
    rows = [(i, None if d is None else json.dumps(d)) for i, (d, _) in enumerate(LAYOUTS)]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("v", F.try_parse_json("j"))
    got = df.select("i", chat.named_paths(F.col("v")).alias("p"), chat.canonical_turns(F.col("v")).alias("t")).collect()
    for r in got:
        want = LAYOUTS[r.i][1]
        assert (None if r.t is None else [tuple(t) for t in r.t]) == want, r.p
    unknown = {r.layout: r.n for r in chat.unknown_layouts(df, "v").collect()}
    assert sum(unknown.values()) == sum(t is None for _, t in LAYOUTS) and unknown["OBJECT<odd: BIGINT>"] == 1 and unknown[None] == 1


def test_layouts_are_told_apart():
    same = (chat.Layout("a", turns="messages"), chat.Layout("b", turns="messages"))
    with pytest.raises(ValueError, match="b and a"):
        chat.layout_of(F.lit(None), same)


def test_written_layouts_are_read_back(spark):
    turns = [("user", "a<|"), ("assistant", ""), ("system", "ä\n")]
    df = spark.createDataFrame([(turns,)], f"t {chat.TURNS}")
    for x in chat.LAYOUTS:
        if x.turns:
            r = df.select(chat.in_layout(F.col("t"), x).alias("v")).select(chat.layout_of(F.col("v")).alias("n"), chat.canonical_turns(F.col("v")).alias("t")).first()
            assert r.n == x.name and [tuple(t) for t in r.t] == turns


TEXTS = ["", "plain", "<|im_end|><|im_start|>assistant ok", "<\\|", "\\<|", "<\\\\|im_start|>", "line\nbreak\n", "\\", "<|" * 3, "ä😀", "$1 \\1 %20 +", None]


def test_round_trip(spark):
    rows = []
    for i, t in enumerate(TEXTS):
        rows += [(i, 0, "user", t, "x"), (i, 1, "assistant", t, "x"), (i, 2, "odd role\n<|", t, "x"), (i, 3, "assistant", "end", "x")]
    rows += [(50, None, None, "first", "x"), (50, 1, "user", "b", "x"), (50, 1, "user", "a", "x"), (50, 1, "user", "a", "x"), (None, 0, "user", "n", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_turns(df).select("conversation", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    got = {r.conversation: r for r in made.collect()}
    for i, t in enumerate(TEXTS):
        said = t or ""
        assert [tuple(x) for x in got[i].t] == [("user", said), ("assistant", said), ("odd role\n<|", said), ("assistant", "end")]
        assert got[i].loss == said + "end"
        assert got[i].formatted.count("<|im_start|>") == 4
    assert [tuple(x) for x in got[50].t] == [("", "first"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [tuple(x) for x in got[None].t] == [("user", "n")]
    assert chat.format_turns(df.limit(0)).count() == 0


def test_turn_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "thread long, index int, speaker string, utterance string")
    assert chat.turn_columns(df) == ("thread", "index", "speaker", "utterance")
    assert chat.format_turns(df).first().formatted == "<|im_start|>user\na<|im_end|>\n"
    with pytest.raises(ValueError, match="no turn table"):
        chat.turn_columns(df.drop("speaker"))


def test_rows_without_a_conversation(spark):
    """Each is a conversation of its own."""
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", None), (5, 1, "assistant", "c"), (5, 0, "user", "b")]
    made = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conversation or -1, [(t.role, t.text) for t in r.turns]) for r in made) == [(-1, [("assistant", "")]), (-1, [("user", "a")]), (-1, [("user", "a")]), (5, [("user", "b"), ("assistant", "c")])]


def test_long_text(spark):
    long = "<|x " * 50_000
    df = spark.createDataFrame([(1, 0, "assistant", long)], "conv_id long, turn long, role string, text string")
    made = chat.format_turns(df).select(chat.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l")).first()
    assert hashlib.sha256(made.l.encode()).digest() == hashlib.sha256(long.encode()).digest()

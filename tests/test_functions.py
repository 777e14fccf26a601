import pytest
from pyspark.sql import functions as F

from caravel.functions import report, training
from caravel.sources import sinks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ints(*values):
    return F.array(*[F.lit(v) for v in values])


def test_messages(spark):
    lit = F.lit
    r = one(
        spark,
        a=training.from_instruction("s", lit("do"), lit(" "), lit("done")),
        b=training.from_instruction("s", lit("do"), lit("this"), lit("done")),
        c=training.from_reasoned("s", lit("q"), lit("t"), lit("r"), True),
        d=training.from_reasoned("s", lit("q"), lit("t"), lit("r"), False),
        e=training.three_messages("s", lit(""), lit("x")),
    )
    assert [m.content for m in r.a] == ["s", "do", "done"]
    assert r.b[1].content == "do\n\nthis"
    assert r.c[2].content == "<think>\nt\n</think>\nr" and r.d[2].content == "r" and r.e is None
    m = F.array(training.message("user", lit("u")), training.message("assistant", lit("a")))
    r = one(spark, a=training.answered(m, lit(None).cast("string"), lit(None).cast("string")), b=training.answered(F.slice(m, 1, 1), lit("q"), lit("w")), c=training.answered(F.slice(m, 1, 1), lit("q"), lit("")), t=training.rendered(m))
    assert [x.content for x in r.a] == ["u", "a"] and [x.content for x in r.b] == ["q", "w"] and r.c is None and r.t == "user: u\nassistant: a"


def test_tokens(spark):
    r = one(
        spark,
        labels=training.labels(ints(5, 6, 7), F.lit(2)),
        padded=training.padded(ints(1, 2), F.lit(4), 0),
        accuracy=training.token_accuracy(ints(1, 2, 3), ints(-100, 2, 4)),
        few=training.spread(ints(1, 2), 4),
        many=training.spread(ints(0, 1, 2, 3, 4, 5, 6, 7, 8), 3),
        cut=training.cut_but_special(ints(101, 1, 2, 3, 4, 102), [101, 102], 4),
        whole=training.cut_but_special(ints(1, 2), [9], 4),
        closed=training.closed_instruction(F.lit(" Do it")),
        stopped=training.limit_reached(ints(1, 2, 9), F.lit(3), [9]),
        full=training.limit_reached(ints(1, 2, 3), F.lit(3), [9]),
    )
    assert r.labels == [-100, -100, 7] and r.padded == [1, 2, 0, 0] and r.accuracy == 0.5
    assert r.few == [1, 2, 2, 2] and r.many == [0, 4, 8] and r.cut == [101, 1, 2, 102] and r.whole == [1, 2]
    assert r.closed == "Do it." and not r.stopped and r.full


def test_reports(spark):
    text = F.lit("Summary: fine\nAdvice：rest, walk\nmore\nRisk: low")
    r = one(
        spark,
        s=report.section(text, "Advice", ["Summary", "Advice", "Risk"]),
        last=report.section(text, "Risk", ["Summary", "Advice", "Risk"]),
        none=report.section(text, "Other", ["Risk"]),
        items=report.items(F.lit("- a；2. b\n\n，c")),
        f=report.field(report.unwrapped(F.parse_json(F.lit('{"data": {"x": "", "y": "v"}}'))), "x", "y"),
        g=report.field(report.unwrapped(F.parse_json(F.lit('{"y": "v"}'))), "x", "y"),
        m=report.merged(F.lit("old"), F.lit(" ")),
        n=report.with_notice(F.lit(" "), "!", "none"),
        l=report.labelled({"a": F.lit("x"), "b": F.lit(" "), "c": F.lit("y")}),
        o=report.objects_in(F.lit('so {"a": {"b": 1}} and {bad} {"c": 2}')),
    )
    assert r.s == "rest, walk\nmore" and r.last == "low" and r.none == "" and r["items"] == ["a", "b", "c"]
    assert r.f == "" and r.g == "v" and r.m == "old" and r.n == "none!" and r.l == "a：x\nc：y"
    assert r.o == ['{"a": {"b": 1}}', '{"c": 2}']


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1, None), ("b", "=1", 2, "n")], "k string, t string, rank int, z string")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())[0] == '{"k":"a","t":"x","rank":1,"z":null}'
    sinks.write_scored(df, str(tmp_path / "s"), "t", F.col("z").isNotNull())
    assert spark.read.json(str(tmp_path / "s/review_needed")).count() == 1
    assert [r.t for r in sinks.sheet(df).orderBy("k").collect()] == ["x", "'=1"]
    assert sinks.chunk_rows(spark.createDataFrame([("k", "abcde")], "k string, t string"), "k", "t", 2).count() == 3
    rows = spark.createDataFrame([("q", 2, "two"), ("q", 1, "one")], "q string, rank int, text string")
    assert sinks.context_blocks(rows, "q", "rank", "text", 6).first().context == "one\n\ntwo"
    with pytest.raises(Exception, match="too long"):
        sinks.context_blocks(rows, "q", "rank", "text", 5).collect()

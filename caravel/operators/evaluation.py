"""Evaluation of runs: what applies to a row, judged stages with caches, counters, run records and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.functions import answers, judgements, text
from caravel.functions.render import percent
from caravel.operators.ordering import ordered_digest
from caravel.operators.plugins import Judge, signature
from caravel.operators.sampling import TYPES
from caravel.session import settled

OBJECTIVE, CHOICE = ("single_choice", "multiple_choice", "closed_ended"), ("single_choice", "multiple_choice")


def applies(metric: str, kind: Column, required: dict[str, Column] | None = None) -> Column:
    """Whether a metric counts for a row of a question type; ``required`` names metrics that a flag of the row decides."""
    if metric in (required or {}):
        return F.coalesce(required[metric], F.lit(False))
    return {"answer_accuracy": kind.isin(*OBJECTIVE), "choice_f1": kind.isin(*CHOICE)}.get(metric, F.lit(True))


def judged(
    rows: DataFrame,
    key: str,
    prompt: str,
    judge: Judge,
    parse: Callable[..., object],
    cache: DataFrame | None = None,
    stage: str = "judge",
    context: str | None = None,
    retries: int = 1,
    tokens: int = 256,
    again: str = "Answer in the required form only.\n",
    **config,
) -> tuple[DataFrame, DataFrame]:
    """(scored, fresh): rows with raw, parsed (JSON), error, attempts and from_cache; and what to append to the cache.

    Rows may share a ``key``; equal prompts of a ``stage`` under equal settings
    have one fingerprint and are asked once, whatever is read of the results later: what was asked is
    written to the shared folder first (a task that is lost asks its prompts
    again).  The cache (fingerprint, raw) holds answers that could be read and
    is trusted only where they still can.  ``parse`` gets the answer, and the
    row's ``context`` if one is named, which is part of the fingerprint.  An
    answer of a wrong form is asked again, ``retries`` times; a cut one (a
    judge may give (text, cut)) has failed, as has an error of the judge
    itself.  What fails has no value, never a score of 0.
    """
    said = F.coalesce(prompt, F.lit(""))
    own = F.coalesce(F.col(context).cast("string"), F.lit("")) if context else F.lit("")
    mark = F.sha2(F.concat_ws("\x1f", F.lit(signature(stage=stage, tokens=tokens, **config)), said, own), 256)
    asked = rows.withColumn("fingerprint", mark)
    once = asked.select("fingerprint", said.alias("prompt"), own.alias("context")).groupBy("fingerprint").agg(F.any_value("prompt").alias("prompt"), F.any_value("context").alias("context"))
    shape = "fingerprint string, raw string, parsed string, error string, attempts int"

    def read(raw: str, about: str) -> tuple[str | None, str | None]:
        try:
            return json.dumps(parse(raw, about) if context else parse(raw), ensure_ascii=False), None
        except ValueError as e:
            return None, str(e) or "unreadable"

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(),) * 4 + (pa.int32(),)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["fingerprint", "raw", "parsed", "error", "attempts"])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of([(f, raw, *read(raw or "", about), 0) for f, raw, about in zip(*(c.to_pylist() for c in b.columns), strict=True)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for f, question, about in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw, parsed, error = None, None, None
                for attempt in range(1, retries + 2):
                    try:
                        answer = judge.text((again if attempt > 1 else "") + question, tokens)
                    except Exception as e:  # the judge failed: asking again would hide it
                        parsed, error = None, f"{type(e).__name__}: {e}"
                        break
                    raw, cut = answer if isinstance(answer, tuple) else (answer, False)
                    if cut:
                        parsed, error = None, "the answer was cut"
                        break
                    parsed, error = read(raw, about)
                    if error is None:
                        break
                out.append((f, raw, parsed, error, attempt))
            yield batch_of(out)

    done = None
    if cache is not None:
        kept = cache.groupBy("fingerprint").agg(F.any_value("raw").alias("raw")).join(once.select("fingerprint", "context"), "fingerprint")
        done = settled(kept.select("fingerprint", "raw", "context").mapInArrow(known, shape).filter("error is null"))
    todo = once if done is None else once.join(done.select("fingerprint"), "fingerprint", "left_anti")
    fresh = settled(todo.mapInArrow(ask, shape))
    every = fresh.withColumn("from_cache", F.lit(False))
    if done is not None:
        every = every.unionByName(done.withColumn("from_cache", F.lit(True)))
    return asked.join(every, "fingerprint"), fresh.filter("error is null").select(F.lit(stage).alias("stage"), "fingerprint", "raw", "parsed")


def claim_batches(facts: DataFrame, key: str, column: str, size: int = 8, *keep: str) -> DataFrame:
    """(key, batch, claims) and columns to ``keep``: the facts of each row in batches of ``size``, with their places from 1 as ids; cut where the row lies.  A key has one row."""
    batch = lambda b: F.transform(F.slice(column, b * size + 1, F.lit(size)), lambda c, i: F.struct((b * size + i + 1).alias("id"), c.alias("claim")))
    cut = F.when(F.size(column) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(column) - 1) / size).cast("int")), batch))
    return facts.select(key, F.posexplode(cut).alias("batch", "claims"), *keep)


def fact_scores(verdicts: DataFrame, key: str, raw: str, claims: str, batches: DataFrame | None = None) -> DataFrame:
    """(key, facts, supported, factscore) of a judge's answers to ``claim_batches``; null where any batch can't be read.

    With ``batches`` (key, batch, claims), all that was asked, a batch that has
    no answer at all counts as one that can't be read.
    """

    def read(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in made:
            good, said = [], []
            for raw_, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                try:
                    found = judgements.read_verdicts(raw_ or "", own)
                    good.append(True)
                    said.append(sum(v["supported"] for v in found))
                except ValueError:
                    good.append(False)
                    said.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.list_value_length(b.column(2)).cast(pa.int64()), pa.array(said, pa.int64()), pa.array(good, pa.bool_())], names=["key", "facts", "supported", "good"])

    kind = verdicts.schema[key].dataType.simpleString()
    if batches is not None:
        answers_ = verdicts.select(F.col(key).alias("_k"), F.col("batch").alias("_b"), F.col(raw).alias("_raw"))
        verdicts = batches.join(answers_, F.col(key).eqNullSafe(F.col("_k")) & (F.col("batch") == F.col("_b")), "left").select(key, F.col("_raw").alias(raw), F.col("claims").alias(claims))
    rows = verdicts.select(F.col(key).alias("key"), raw, F.transform(claims, lambda c: c["id"]).alias("ids")).mapInArrow(read, f"key {kind}, facts long, supported long, good boolean")
    whole = F.every("good")
    return rows.groupBy(F.col("key").alias(key)).agg(F.sum("facts").alias("facts"), F.when(whole, F.sum("supported")).alias("supported"), F.when(whole, F.sum("supported") / F.sum("facts")).alias("factscore"))


def fact_precision(rows: DataFrame, key: str, question: str, reference: str, prediction: str, judge: Judge, prompts: tuple[str, str], cache: DataFrame | None = None, size: int = 8, tokens: int = 1024, **config) -> tuple[DataFrame, DataFrame]:
    """(scores, fresh): (key, factscore, facts, supported, fact_status, fact_reason) of answers whose facts a judge lists and then checks.

    Each answer's last words, without thoughts, are cut into facts (stage
    ``extract``); facts are checked against the reference in batches of
    ``size`` (stage ``verify``), whose ids the answer must name once each.  An
    empty answer, and one without facts, scores 0.  A row without question or
    reference has failed, and so has one of which any stage or batch failed: it
    has no score.
    """
    final = text.final_text(F.coalesce(prediction, F.lit("")))
    own = rows.select(key, F.trim(question).alias("_q"), F.trim(reference).alias("_r"), final.alias("_p"), F.col(prediction).isNull().alias("_none"))
    lost = (F.coalesce("_q", F.lit("")) == "") | (F.coalesce("_r", F.lit("")) == "") | F.col("_none")
    able = own.filter(~lost & (F.col("_p") != ""))
    extract = able.withColumn("_prompt", F.concat(F.lit(prompts[0] + "\n"), F.to_json(F.struct(F.col("_q").alias("question"), F.col("_p").alias("prediction")))))
    listed, first = judged(extract, key, "_prompt", judge, judgements.read_facts, cache, "extract", tokens=tokens, **config)
    listed = settled(listed.select(key, "_q", "_r", F.from_json("parsed", "array<string>").alias("_facts"), "error"))
    batches = settled(claim_batches(listed.filter("size(_facts) > 0"), key, "_facts", size, "_q", "_r"))
    names = F.to_json(F.transform("claims", lambda c: c["id"]))
    verify = batches.withColumn("_ids", names)
    verify = verify.withColumn("_prompt", F.concat(F.lit(prompts[1] + "\n"), F.to_json(F.struct(F.col("_q").alias("question"), F.col("_r").alias("reference"), F.col("claims").alias("claims")))))
    checked, second = judged(verify, key, "_prompt", judge, lambda raw, ids: judgements.read_verdicts(raw, json.loads(ids)), cache, "verify", "_ids", tokens=tokens, **config)
    # every batch is among what was checked; one that failed has no answer
    made = fact_scores(checked.withColumn("raw", F.when(F.col("error").isNull(), F.col("raw"))), key, "raw", "claims")
    out = own.select(key, lost.alias("_lost"), (F.col("_p") == "").alias("_empty")).join(listed.select(key, F.size("_facts").alias("_n"), "error"), key, "left").join(made, key, "left")
    none = ((F.col("_n") == 0) | F.col("_empty")) & ~F.col("_lost")
    reason = F.when(F.col("_lost"), "question, reference or answer is missing").when(F.col("_empty"), "empty_answer").when(F.col("error").isNotNull(), F.concat(F.lit("facts weren't listed: "), "error")).when(F.col("_n") == 0, "no_claims").when(F.col("factscore").isNull(), "a batch of facts wasn't checked").otherwise(F.concat_ws("/", F.col("supported").cast("string"), F.col("facts").cast("string")))
    score = F.when(F.col("_lost"), F.lit(None)).when(none, 0.0).otherwise(F.col("factscore"))
    scores = out.select(key, score.alias("factscore"), F.when(none, 0).otherwise(F.col("facts")).cast("long").alias("facts"), F.when(none, 0).otherwise(F.col("supported")).cast("long").alias("supported"), F.when(score.isNull(), "judge_failed").otherwise("ok").alias("fact_status"), reason.alias("fact_reason"))
    return scores, first.unionByName(second)


def judge_pending(rows: DataFrame, key: str, judge: Judge, prompts: tuple[str, str, str], cache: DataFrame | None = None, size: int = 8, **config) -> tuple[DataFrame, DataFrame]:
    """(rows, fresh): the rows with what was pending judged: facts first, then meaning.

    ``rows`` has question, reference, prediction, fact_required,
    semantic_required, factscore, fact_status, semantic and semantic_status.
    Only rows that need a stage and have no status for it (null or ``pending``)
    are asked; the others keep what they have, those that need no stage get
    ``not_required``.  ``prompts``: to list facts, to check them, to compare
    meanings.
    """
    open_ = lambda stage: F.coalesce(F.col(f"{stage}_required"), F.lit(False)) & (F.coalesce(f"{stage}_status", F.lit("pending")) == "pending")
    facts, fresh = fact_precision(rows.filter(open_("fact")), key, "question", "reference", "prediction", judge, prompts[:2], cache, size, **config)
    asked = rows.filter(open_("semantic")).withColumn("_prompt", F.concat(F.lit(prompts[2] + "\n"), F.to_json(F.struct("question", "reference", "prediction"))))
    meant, more = judged(asked, key, "_prompt", judge, judgements.read_judgement, cache, "semantic", **config)
    meant = meant.select(F.col(key).alias("_k2"), F.get_json_object("parsed", "$.correctness").cast("double").alias("_s"), F.when(F.col("error").isNull(), "ok").otherwise("judge_failed").alias("_s_status"))
    facts = facts.select(F.col(key).alias("_k1"), F.col("factscore").alias("_f"), F.col("fact_status").alias("_f_status"))
    joined = rows.join(facts, F.col(key) == F.col("_k1"), "left").join(meant, F.col(key) == F.col("_k2"), "left")
    state = lambda stage, new: F.when(~F.coalesce(F.col(f"{stage}_required"), F.lit(False)), "not_required").otherwise(F.coalesce(new, f"{stage}_status", F.lit("pending")))
    changed = {"factscore": F.when(F.col("_f_status").isNotNull(), F.col("_f")).otherwise(F.col("factscore")), "fact_status": state("fact", "_f_status"), "semantic": F.when(F.col("_s_status").isNotNull(), F.col("_s")).otherwise(F.col("semantic")), "semantic_status": state("semantic", "_s_status")}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in rows.columns]), fresh.unionByName(more)


def scored_run(samples: DataFrame, generations: DataFrame, key: str, reserved: DataFrame | None = None) -> DataFrame:
    """Samples (key, kind, options, reference) with the prediction of each and its objective score.

    Every sample has one generation at most; a generation of an id that isn't
    asked raises.  ``reserved``: ids that must not be in the generations' evidence
    (column ``evidence``, ids); one that is raises.
    """
    unknown = generations.join(samples.select(key), key, "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"a generation of no sample: {unknown[0][key]}")
    if reserved is not None:
        leaks = generations.select(F.explode("evidence").alias("_id")).join(reserved.select(F.col(key).alias("_id")), "_id", "left_semi").limit(1).collect()
        if leaks:
            raise ValueError(f"a reserved sample is in the evidence: {leaks[0][0]}")
    joined = samples.join(generations.select(key, "prediction"), key, "left")
    return answers.with_score(joined, into="_score").select(*joined.columns, "_score.status", "_score.accuracy", "_score.f1")


def run_counters(rows: DataFrame, status: str = "status", judge: str = "judge_status", cached: str = "from_cache", truncated: str = "hit_limit", seconds: str = "seconds") -> DataFrame:
    """One row: failures to read, invalid references, judge failures, what is pending, cached, cut, the seconds not from a cache, and the state."""
    s, j = F.col(status), F.col(judge)
    pending, failed = F.count_if(j == "pending"), F.count_if(j == "judge_failed")
    return rows.agg(
        F.count("*").alias("samples"),
        F.count_if(s == "prediction_unparseable").alias("parse_failures"),
        F.count_if(s == "invalid_reference").alias("invalid_references"),
        failed.alias("judge_failures"),
        pending.alias("judge_pending"),
        F.count_if(F.col(cached)).alias("cached"),
        F.count_if(F.col(truncated)).alias("truncations"),
        F.coalesce(F.sum(F.when(~F.coalesce(F.col(cached), F.lit(False)), F.col(seconds))), F.lit(0.0)).alias("seconds"),
        F.when(pending > 0, "pending").when(failed > 0, "needs_review").otherwise("complete").alias("state"),
    )


def run_record(rows: DataFrame, group: str, key: str, seconds: str, *values: str) -> DataFrame:
    """(group, samples, seconds, fingerprint) of runs of any size: the digest of each run's rows in the order of their keys, as a tree."""
    own = rows.select(group, key, seconds, F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (key, *values)]), 256).alias("_h"))
    made = own.groupBy(group).agg(F.count("*").alias("samples"), F.sum(seconds).alias("seconds"))
    tree = ordered_digest(own, group, key, "_h").select(F.col(group).alias("_g"), F.col("digest").alias("fingerprint"))
    return made.join(tree, F.col(group).eqNullSafe(F.col("_g"))).select(group, "samples", "seconds", "fingerprint")


def one_test_set(records: DataFrame, fingerprint: str) -> bool:
    """Whether all runs have the same test data."""
    return records.select(fingerprint).distinct().limit(2).count() <= 1


def truncations(rows: DataFrame, limit: str, cut: str) -> DataFrame:
    """(limit, n): how many generations each token limit cut."""
    return rows.filter(F.col(cut)).groupBy(limit).agg(F.count("*").alias("n"))


def counter_delta(after: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """(key, delta) of two counters; a key that is in one only counts as 0 in the other; unchanged keys are left out."""
    a, b = after.select(key, F.col(value).alias("_a")), before.select(key, F.col(value).alias("_b"))
    delta = F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))
    return a.join(b, key, "full_outer").select(key, delta.alias("delta")).filter("delta <> 0")


def token_lengths(rows: DataFrame, ids: str, labels: str, ignore: int = -100) -> DataFrame:
    """One row: samples, least, most and mean number of ids, and how many labels are learnt from."""
    n, own = F.size(ids), F.size(F.filter(labels, lambda x: x != ignore))
    return rows.agg(F.count("*").alias("samples"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.sum(own).alias("supervised"))


def equal_keys(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both runs; raises unless each has every key of the other, once."""
    for name, df in (("first", a), ("second", b)):
        if df.groupBy(key).count().filter(f"count > 1 or {key} is null").limit(1).collect():
            raise ValueError(f"{key} repeated or null in the {name} run")
    off = a.select(key).join(b.select(key), key, "left_anti").unionByName(b.select(key).join(a.select(key), key, "left_anti")).limit(5).collect()
    if off:
        raise ValueError("in one run only: " + ", ".join(sorted(str(r[0]) for r in off)))
    return a, b


def paired_runs(rows: DataFrame, pairs: DataFrame, run: str, key: str, metrics: dict[str, Column | None]) -> DataFrame:
    """(fine, base, metric, n, total, delta) of all pairs of runs at once: mean differences over the rows to which a metric applies.

    ``rows`` has every run's rows; ``metrics`` names their columns, each with
    the condition under which it applies (None: always).  The runs of a pair
    must have the same keys, once each; one that hasn't raises.  A difference
    with a null side isn't counted in ``n``.
    """
    sizes = rows.groupBy(F.col(run).alias("_run")).agg(F.count("*").alias("_n"), F.count_distinct(key).alias("_keys"))
    a, b = rows.alias("a"), rows.alias("b")
    both = pairs.join(a, F.col("fine") == F.col(f"a.{run}")).join(b, (F.col("base") == F.col(f"b.{run}")) & (F.col(f"a.{key}") == F.col(f"b.{key}")))
    size = lambda side: sizes.select(F.col("_run").alias(f"_{side}"), F.col("_n").alias(f"_{side}_n"), F.col("_keys").alias(f"_{side}_keys"))
    shared = both.groupBy("fine", "base").agg(F.count("*").alias("_both")).withColumnsRenamed({"fine": "_f", "base": "_b"})
    checked = pairs.join(size("x"), F.col("fine") == F.col("_x"), "left").join(size("y"), F.col("base") == F.col("_y"), "left").join(shared, (F.col("fine") == F.col("_f")) & (F.col("base") == F.col("_b")), "left")
    fine = (F.col("_x_n") == F.col("_x_keys")) & (F.col("_y_n") == F.col("_y_keys")) & (F.col("_x_n") == F.col("_y_n")) & (F.col("_both") == F.col("_x_n"))
    wrong = checked.filter(~F.coalesce(fine, F.lit(False))).limit(5).collect()
    if wrong:
        raise ValueError("runs of other keys: " + ", ".join(sorted(f"{r['fine']} and {r['base']}" for r in wrong)))
    used = rows.select(run, key, *[F.when(F.lit(True) if c is None else c, F.struct(F.col(m).cast("double").alias("v"))).alias(m) for m, c in metrics.items()])
    a, b = used.alias("a"), used.alias("b")
    joined = pairs.join(a, F.col("fine") == F.col(f"a.{run}")).join(b, (F.col("base") == F.col(f"b.{run}")) & (F.col(f"a.{key}") == F.col(f"b.{key}")))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"a.{m}").isNotNull() & F.col(f"b.{m}").isNotNull()).alias("applies"), (F.col(f"a.{m}.v") - F.col(f"b.{m}.v")).alias("d")) for m in metrics])
    long = joined.select("fine", "base", F.explode(each).alias("m")).filter("m.applies")
    return long.groupBy("fine", "base", "m.metric").agg(F.count("m.d").alias("n"), F.count("*").alias("total"), F.avg("m.d").alias("delta"))


def type_report(rows: DataFrame, run: str, kind: str, metrics: list[str], base: str) -> DataFrame:
    """(kind, run, metric, n, percent, delta): means by type (all fixed types) in percent, and points above the run ``base``."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = rows.select(run, kind, F.explode(each).alias("m")).select(run, kind, "m.*")
    grid = rows.select(run).distinct().select(run, F.explode(F.array(*[F.lit(t) for t in TYPES])).alias(kind)).select("*", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    found = long.groupBy(run, kind, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    full = grid.join(found, [run, kind, "metric"], "left").fillna(0, ["n"])
    other = F.max(F.when(F.col(run) == base, F.col("mean"))).over(Window.partitionBy(kind, "metric"))
    return full.select(kind, run, "metric", "n", percent(F.col("mean")).alias("percent"), percent(F.col("mean") - other).alias("delta"))


def markdown(report: DataFrame, *columns: str) -> DataFrame:
    """(line): rows of a Markdown table, without its head."""
    return report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |")).alias("line"))


#: What a detail sheet has beside names of metrics, in order.
DETAIL = ("id", "question_type", "question", "answer", "reference", "prediction", "normalized_prediction", "normalized_reference")
DETAIL_STATES = ("status", "answer_details", "fact_status", "fact_reason", "semantic_status", "semantic_reason", "explanation_status", "generation_info", "retrieved_count")


def detail(rows: DataFrame, label: str, metrics: list[str], reasons: Column, types: dict[str, str] | None = None) -> DataFrame:
    """The fields of a detail sheet: who, what was asked, said and expected, metrics in percent, states, and why it needs review.

    Columns that ``rows`` hasn't are null; without an answer the reference
    stands for it; question types get the names in ``types``; structs are
    written as JSON; nothing retrieved counts as 0.
    """
    nested = {n for n, k in rows.dtypes if k.startswith(("struct", "array", "map"))}
    plain = lambda n: F.to_json(n) if n in nested else F.col(n)
    have = lambda n: plain(n) if n in rows.columns else F.lit(None)
    names = F.create_map(*[F.lit(x) for kv in (types or {}).items() for x in kv]) if types else None
    kind = have("question_type" if "question_type" in rows.columns else "kind")
    made = {"question_type": F.coalesce(names[kind], kind) if types else kind, "answer": F.coalesce(have("answer"), have("reference")), "retrieved_count": F.coalesce(have("retrieved_count"), F.lit(0))}
    field = lambda n: made.get(n, have(n)).alias(n)
    return rows.select(F.lit(label).alias("run"), *[field(n) for n in DETAIL], *[percent(F.col(m)).alias(m) for m in metrics], *[field(n) for n in DETAIL_STATES], (reasons != "").alias("needs_review"), reasons.alias("reasons"))

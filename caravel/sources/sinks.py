"""Writing results: JSON lines, tables by type, manifests, context blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caravel.functions.text import neutral_formula


def write_json_lines(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A JSON object a line; nulls are written, nothing is escaped beyond JSON."""
    fields = columns or df.columns
    df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_scored(df: DataFrame, path: str, kind: str, review: Column) -> None:
    """All rows, rows by question type, and rows for review."""
    df.write.mode("overwrite").json(f"{path}/predictions")
    df.withColumn("_kind", F.col(kind)).write.mode("overwrite").partitionBy("_kind").json(f"{path}/by_type")
    df.filter(review).write.mode("overwrite").json(f"{path}/review_needed")


#: What stands at the end of a cell that was cut, and the room that is kept for it. Fixed values.
CUT_NOTICE, CUT_ROOM = "…（内容过长，完整内容见原始记录页）", 40


def sheet(df: DataFrame, limit: int = 30_000) -> DataFrame:
    """Columns as a spreadsheet takes them: nested values as JSON, no formulas; cells of more than ``limit`` characters are cut and say so."""
    short = lambda c: F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit - CUT_ROOM), F.lit(CUT_NOTICE))).otherwise(c)
    nested = lambda t: t.startswith(("array", "struct", "map"))
    cells = []
    for name, kind in df.dtypes:
        text = F.to_json(name) if nested(kind) else F.col(name)
        cells.append((short(neutral_formula(text)) if nested(kind) or kind == "string" else text).alias(name))
    return df.select(*cells)


def write_manifest(train: DataFrame, test: DataFrame, key: str, path: str) -> None:
    """JSON lines (role, id) of both roles, sorted within partitions: no list of all ids is held anywhere.

    An id in both roles raises.
    """
    both = train.select(key).join(test.select(key), key, "left_semi").limit(1).collect()
    if both:
        raise ValueError(f"in both roles: {both[0][0]}")
    roles = [df.select(F.lit(r).alias("role"), F.col(key).cast("string").alias("id")).distinct() for r, df in (("train", train), ("test", test))]
    write_json_lines(roles[0].unionByName(roles[1]).repartitionByRange("role", "id").sortWithinPartitions("role", "id"), path)


def write_summary(counts: DataFrame, path: str, **facts) -> None:
    """A JSON file with a row of counts and given facts; ``counts`` has one row."""
    write_json_lines(counts.select("*", *[F.lit(v).alias(k) for k, v in facts.items()]).coalesce(1), path)


def write_text(df: DataFrame, path: str, *fields: str) -> None:
    """The fields of each row as lines, a blank line behind each row; empty ones are left out."""
    lines = [F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields]
    df.select(F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def restored(chunks: DataFrame, key: str) -> DataFrame:
    """(key, text): ``chunk_rows`` put together again; a part that is missing or repeated raises."""
    rows = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("x"), F.max("total").alias("total"))
    whole = F.transform("x", lambda p: p["part"]) == F.sequence(F.lit(0), F.col("total") - 1)
    text = F.array_join(F.transform("x", lambda p: p["content"]), "")
    return rows.select(key, F.when(whole, text).otherwise(F.raise_error(F.concat(F.lit("parts are missing or repeated: "), F.col(key).cast("string"))).cast("string")).alias("text"))


def chunk_rows(df: DataFrame, key: str, text: str, size: int = 15_000) -> DataFrame:
    """(key, part, total, content): long texts in parts."""
    from caravel.functions.text import chunks

    parts = df.select(key, chunks(F.col(text), size).alias("_p"))
    return parts.select(key, F.size("_p").alias("total"), F.posexplode("_p").alias("part", "content"))


def context_blocks(evidence: DataFrame, query: str, rank: str, text: str, limit: int) -> DataFrame:
    """(query, context): evidence in the order of ranks; a context over ``limit`` characters is an error, never cut."""
    order = Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    sized = evidence.withColumn("_n", F.sum(F.char_length(text)).over(order))
    fine = sized.withColumn(text, F.when(F.col("_n") > limit, F.raise_error(F.lit("the context is too long")).cast("string")).otherwise(F.col(text)))
    return fine.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(rank, text))).alias("x")).select(query, F.array_join(F.transform("x", lambda x: x[text]), "\n\n").alias("context"))


def write_selection_audit(left_out: DataFrame, path: str, **policy) -> int:
    """Write which samples were left out and under which policy, before anything is done with the others; how many they are.

    The policy is a JSON file, the samples are JSON lines in the order of their ids.
    """
    write_json_lines(left_out.repartitionByRange("id").sortWithinPartitions("id"), f"{path}/left_out")
    n = left_out.sparkSession.read.text(f"{path}/left_out").count()
    write_summary(left_out.sparkSession.range(1).select(F.lit(n).alias("left_out")), f"{path}/policy", **policy)
    return n

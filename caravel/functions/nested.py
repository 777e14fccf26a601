"""Nested JSON values as text."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caravel.functions.text import json_value


def leaves(value) -> list[str]:
    """The string leaves of a nested value, in order; keys don't count."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        value = list(value.values())
    return [x for v in value for x in leaves(v)] if isinstance(value, list) else []


def flat_text(value, objects: bool = True) -> str:
    """Nested values as lines: texts trimmed, empty ones left out; objects by their values, or as written if not ``objects``."""
    if value is None:
        return ""
    if isinstance(value, dict) and objects:
        value = list(value.values())
    if isinstance(value, list):
        return "\n".join(x for v in value if (x := flat_text(v, objects)))
    return value.strip() if isinstance(value, str) else str(value)


# values keep the order of their document only outside variants, hence these two helpers
@F.arrow_udf(T.ArrayType(T.StringType()))
def json_leaves(text: pa.Array) -> pa.Array:
    """The string leaves of a JSON text; null for a null, an error for no JSON."""
    return pa.array([None if t is None else leaves(json.loads(t)) for t in text.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def json_flat(text: pa.Array) -> pa.Array:
    """``flat_text`` of a JSON text."""
    return pa.array([None if t is None else flat_text(json.loads(t)) for t in text.to_pylist()], pa.string())


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces; an error for a text that isn't JSON, null for a null.

    A variant keeps the fields of objects sorted, so writing one gives the
    canonical text; repeated keys are refused.
    """
    value = json_value(text)
    return F.when(text.isNull(), F.lit(None).cast("string")).when(value.isNull(), F.raise_error(F.concat(F.lit("no JSON: "), F.substring(text, 1, 80))).cast("string")).otherwise(F.to_json(value))

"""Values of any type in one column: scalars, lists, objects and null, as VARIANT.

JSON is read once into a VARIANT; lists in lists come apart by flattening as often as the text has opening brackets, which is
as deep as they can be.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_missing, strip

TEXTS = r'"(?:[^"\\]|\\.)*"'


def parsed(value: Column) -> Column:
    """The VARIANT of a JSON list, object or text in quotes; any other text stands for itself, as a VARIANT of a string."""
    plain = strip(value)
    json = F.try_parse_json(F.when(plain.rlike(r'^[\[{"]'), plain))
    return F.when(value.isNotNull(), F.coalesce(json, F.try_parse_json(quoted(value))))


def quoted(value: Column) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def elements(value: Column) -> Column:
    """A VARIANT as an array: a list's elements; null and JSON null as none; anything else as one."""
    none = F.array().cast("array<variant>")
    return F.when(value.isNull() | F.is_variant_null(value), none).otherwise(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value)))


def leaves(value: Column, json: Column) -> Column:
    """What a VARIANT holds that is no list, in order, out of lists of any depth. json: the text that it was read from."""
    depth = F.regexp_count(F.regexp_replace(F.coalesce(json, F.lit("")), TEXTS, ""), F.lit(r"\["))
    more = lambda held: F.flatten(F.transform(held, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))))
    deep = F.aggregate(F.sequence(F.lit(1), depth), F.array(value), lambda held, _: more(held))
    return F.when(value.isNull(), F.array().cast("array<variant>")).when(depth > 0, deep).otherwise(F.array(value))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def holds(value: Column) -> Column:
    """Whether a VARIANT that is no list holds anything: an object with a field, or a scalar whose text is not missing."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    return F.when(kind.startswith("OBJECT"), kind != "OBJECT<>").otherwise(~is_missing(F.try_variant_get(value, "$", "string")))


def text_of(value: Column) -> Column:
    """A VARIANT as a text: a string itself, other values as JSON, null for null."""
    return F.when(~F.is_variant_null(value), F.try_variant_get(value, "$", "string"))

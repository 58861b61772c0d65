"""Slice keys (a tag and its value) and the tags of a clip, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = "tag string, value string"


def slice_label(tag: Column, value: Column) -> Column:
    """tag=value."""
    return F.concat(tag, F.lit("="), value)


def slice_json(tag: Column, value: Column) -> Column:
    return F.to_json(F.struct(tag.alias("tag"), value.alias("value")))


def slice_from_json(payload: Column, strict: bool = True) -> Column:
    """struct(tag, value) of a JSON text; one that lacks either is an error, or null where not strict."""
    key = F.from_json(payload, KEY)
    good = (F.coalesce(key["tag"], F.lit("")) != "") & key["value"].isNotNull()
    other = F.raise_error(F.concat(F.lit("not a slice key: "), F.coalesce(payload, F.lit("null")))).cast(f"struct<{KEY.replace(' string', ':string')}>")
    return F.when(good, key).otherwise(other) if strict else F.when(good, key)


def tag_names(tags: Column) -> Column:
    """Names of the tags that have a value, in order; null has none."""
    return F.coalesce(F.array_sort(F.map_keys(F.map_filter(tags, lambda _, v: v.isNotNull()))), F.array().cast("array<string>"))


def numeric_value(value: Column, reason: Column) -> Column:
    """The value of a metric; one that is not available is an error with its reason."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("not available: "), F.coalesce(reason, F.lit("no reason")))).cast("double"))

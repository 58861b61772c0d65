"""Typed "not available" values: value DOUBLE and na_reason STRING, exactly one of them null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "__not_available__ boolean, reason string, metric_name string"


def metric(name: str, value: Column, reasons: list[tuple[Column, str]] | None = None, higher_is_better: bool = True) -> Column:
    """A metric row: the first reason whose condition holds stands in for the value."""
    why = F.lit(None).cast("string")
    for condition, text in reversed(reasons or []):
        why = F.when(condition, F.lit(text)).otherwise(why)
    return F.struct(
        F.lit(name).alias("name"), F.when(why.isNull(), value.cast("double")).alias("value"), why.alias("na_reason"), F.lit(higher_is_better).alias("higher_is_better")
    )


def encode(value: Column, reason: Column, name: Column) -> Column:
    """JSON of a value: the number, or a marker with the reason and the metric's name."""
    marker = F.to_json(F.struct(F.lit(True).alias("__not_available__"), reason.alias("reason"), name.alias("metric_name")))
    return F.when(value.isNull(), marker).otherwise(value.cast("string"))


def is_marker(payload: Column) -> Column:
    """Whether a JSON text is a marker with a reason."""
    m = F.from_json(payload, MARKER)
    return F.coalesce(m["__not_available__"] & (F.coalesce(m["reason"], F.lit("")) != ""), F.lit(False))


def decode(payload: Column) -> Column:
    """(value, na_reason) of a JSON text; texts that are neither a number nor a marker, booleans too, give both null."""
    m = F.from_json(payload, MARKER)
    number = F.when(~is_marker(payload), payload.try_cast("double"))
    return F.struct(number.alias("value"), F.when(is_marker(payload), m["reason"]).alias("na_reason"))


def shown(value: Column, reason: Column) -> Column:
    """Text of a value: the number, or n/a and the reason in brackets."""
    return F.coalesce(value.cast("string"), F.concat(F.lit("n/a ("), reason, F.lit(")")))


def described(reason: Column, name: Column) -> Column:
    """A value that is not available, for logs: with its metric's name where it has one."""
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    named = F.when(F.coalesce(name, F.lit("")) != "", F.concat(quoted(name), F.lit(", "))).otherwise("")
    return F.concat(F.lit("NotAvailable("), named, F.lit("reason="), quoted(reason), F.lit(")"))

"""Exact quantiles and ranks by ranges: splitters from a quantile sketch, counts by range, ranks in the ranges that hold them."""

from __future__ import annotations

from functools import reduce
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that values are cut into; a range holds about this part of all distinct values, whatever their scale.
RANGES = 1024


def splitters(rows: DataFrame, column: str | Column, ranges: int = RANGES) -> list[float]:
    """At most ranges - 1 ascending values that cut the column into ranges of about the same number of rows.

    One job; its sketches merge, and only the splitters reach the driver, so that all uses of them agree.
    """
    c = F.col(column) if isinstance(column, str) else column
    at = [k / ranges for k in range(1, ranges)]
    found = rows.where(c.isNotNull() & ~F.isnan(c.cast("double"))).agg(F.approx_percentile(c.cast("double"), at, 10 * ranges).alias("s")).first()["s"]
    return sorted({x for x in found or [] if isfinite(x)})


def range_of(value: Column, cuts: list[float]) -> Column:
    """Number of splitters that are less than the value: ranges are (cut, cut].  Null and NaN values give the last range."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    every = F.array(*(F.lit(x) for x in cuts))
    coarse = F.array(*(F.lit(x) for x in cuts[width - 1 :: width]))
    block = F.size(F.filter(coarse, lambda x: x < value.cast("double")))
    inside = F.size(F.filter(F.slice(every, block * width + 1, F.lit(width)), lambda x: x < value.cast("double")))
    return F.coalesce(block * width + inside, F.lit(len(cuts)))


def exact_percentiles(rows: DataFrame, column: str, probabilities: dict[str, float], keys: tuple[str, ...] = (), ranges: int = RANGES) -> DataFrame:
    """(keys, n, a column for each name in ``probabilities``): percentiles between neighbouring values, as linear interpolation has them.

    Null and NaN values don't count; keys may be null; a key without values has no row, and without keys an empty table gives one row of nulls and n 0.
    No task holds all values: counts of ranges give the ranges in which the wanted ranks lie, and only the rows of these
    are sorted, equal values as one.
    """
    value = F.col(column).cast("double")
    rows = rows.where(value.isNotNull() & ~F.isnan(value)).select(*keys, value.alias("__v"))
    rows = rows.withColumn("__r", range_of(F.col("__v"), splitters(rows, "__v", ranges)))
    whole, ids = W.partitionBy(*keys), [F.col(k) for k in keys]
    upto = whole.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "__r").agg(F.count("*").alias("__m"))
    counts = counts.select(*ids, "__r", "__m", F.coalesce(F.sum("__m").over(upto), F.lit(0)).alias("__before"), F.sum("__m").over(whole).alias("n"))
    wanted = []
    for name, p in probabilities.items():
        at = F.lit(p) * (F.col("n") - 1)
        wanted += [F.struct(F.lit(name).alias("name"), F.lit(k).alias("part"), f(at).cast("long").alias("rank"), (at - F.floor(at)).alias("weight")) for k, f in enumerate((F.floor, F.ceil))]
    held = counts.withColumn("w", F.explode(F.array(*wanted))).where((F.col("w.rank") >= F.col("__before")) & (F.col("w.rank") < F.col("__before") + F.col("__m")))
    held = held.groupBy(*keys, "__r", "__before", "n").agg(F.collect_list("w").alias("w"))  # at most two for each probability
    held = held.withColumnsRenamed({k: f"__k_{k}" for k in keys} | {"__r": "__held"})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__r") == F.col("__held"))
    inside = rows.join(held, same).select(*keys, "__r", "__v", "__before", "n", "w")
    at = inside.groupBy(*keys, "__r", "__v").agg(F.count("*").alias("__m"), F.first("__before").alias("__before"), F.first("n").alias("n"), F.first("w").alias("w"))
    end = F.col("__before") + F.sum("__m").over(W.partitionBy(*keys, "__r").orderBy("__v"))
    at = at.withColumn("__end", end).withColumn("w", F.explode("w")).where((F.col("w.rank") < F.col("__end")) & (F.col("w.rank") >= F.col("__end") - F.col("__m")))
    part = lambda name, k: F.max(F.when((F.col("w.name") == name) & (F.col("w.part") == k), F.col("__v")))
    weight = lambda name: F.max(F.when(F.col("w.name") == name, F.col("w.weight")))
    # a value is never added to an infinite one times zero
    between = {name: F.when(part(name, 0) == part(name, 1), part(name, 0)).otherwise(part(name, 0) * (1 - weight(name)) + part(name, 1) * weight(name)) for name in probabilities}
    out = at.groupBy(*keys).agg(F.max("n").alias("n"), *(c.alias(name) for name, c in between.items()))
    return out if keys else out.withColumn("n", F.coalesce("n", F.lit(0)))

"""Training examples: frames of a window put together and checked, splits, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.functions import fixed


def offset_errors(members: DataFrame, key: str, offset: str, length: Column) -> DataFrame:
    """(key, error, missing) of groups whose offsets aren't exactly 0..length-1.

    Duplicates come first, then too few, too many, then a wrong sequence.
    """
    o = F.col(offset)
    g = members.groupBy(key).agg(
        F.count("*").alias("n"), F.count_distinct(o).alias("d"), F.min(o).alias("low"), F.max(o).alias("high"), F.max(length).cast("long").alias("len"), F.collect_set(o.cast("long")).alias("set")
    )
    error = (
        F.when(F.col("d") < F.col("n"), "duplicate").when(F.col("n") < F.col("len"), "missing").when(F.col("n") > F.col("len"), "length")
        .when((F.col("low") != 0) | (F.col("high") != F.col("len") - 1), "sequence")
    )
    missing = F.sort_array(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("len") - 1), F.col("set")))
    return g.withColumn("error", error).where("error is not null").select(key, "error", missing.alias("missing"))


def inconsistent(members: DataFrame, key: str, columns: tuple[str, ...] = fixed.PROVENANCE) -> DataFrame:
    """Groups in which a column has more than one value: (key, columns)."""
    g = members.groupBy(key).agg(*(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in columns))
    bad = F.array_compact(F.array(*(F.when(F.col(c) > 1, F.lit(c)) for c in columns)))
    return g.select(key, bad.alias("columns")).where(F.size("columns") > 0)


def assemble(members: DataFrame, key: str = "window_key") -> DataFrame:
    """One row per window: frames in order of their offsets, mask of missing ones, mean coverage (1 where unknown)."""
    frame = F.struct("frame_offset", "frame_index", F.coalesce("missing_frame", F.lit(False)).alias("missing_frame"))
    g = members.groupBy(key).agg(
        F.sort_array(F.collect_list(frame)).alias("f"), F.avg(F.coalesce("coverage", F.lit(1.0))).alias("coverage"),
        *(F.min(c).alias(c) for c in fixed.PROVENANCE if c in members.columns),
    )
    return g.select(
        "*", F.transform("f", lambda x: x["frame_index"]).alias("frame_indices"), F.transform("f", lambda x: x["missing_frame"]).alias("mask"),
        F.size(F.filter("f", lambda x: x["missing_frame"])).alias("n_missing"),
    ).drop("f")


def window_members(members: DataFrame, window_key: str, name: str = "member") -> DataFrame:
    """Members of exactly one window: the name without its _NNNN offset is the key, so t7 never takes t70's."""
    return members.where(F.regexp_replace(name, r"_\d+(\.[^.]*)*$", "") == window_key)


def stratified_split(rows: DataFrame, key: str, stratum: str, train: float = 0.7, validate: float = 0.15, seed: str = "42") -> DataFrame:
    """(key, stratum, split): within a stratum, by a hash of the key: validate, test, then train, by half-even quotas.

    Ranks come in two steps, over 4096 buckets of the hash and in a bucket, so no task sorts a whole stratum.
    """
    order = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")).cast("binary"))
    rows = rows.select(key, stratum, order.alias("__o"), F.substring(order, 1, 3).alias("__b"))
    sizes = rows.groupBy(F.col(stratum).alias("__s"), F.col("__b").alias("__c")).agg(F.count("*").alias("m"))
    before = F.sum("m").over(W.partitionBy("__s").orderBy("__c").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("__s", "__c", F.coalesce(before, F.lit(0)).alias("before"), F.sum("m").over(W.partitionBy("__s")).alias("n"))
    rank = F.row_number().over(W.partitionBy(stratum, "__b").orderBy("__o", key))
    rows = rows.withColumn("__r", rank).join(sizes, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__c")))
    rows = rows.select(key, stratum, "n", (F.col("before") + F.col("__r")).alias("r"))
    quota_v, quota_t = F.bround(F.col("n") * validate), F.bround(F.col("n") * (1 - train - validate + 1e-12))
    split = F.when(F.col("r") <= quota_v, "validate").when(F.col("r") <= quota_v + quota_t, "test").otherwise("train")
    return rows.select(key, stratum, split.alias("split"))


def first_per_class(rows: DataFrame, label: str, order: str, count: int = 3) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(label).orderBy(order))
    return rows.withColumn("__r", rank).where(F.col("__r") <= count).drop("__r")


def count_guard(rows: DataFrame, bounds: dict[str, tuple[Column, int, int]]) -> DataFrame:
    """(name, n, low, high, ok) for each aggregate that has to lie in its bounds."""
    n = rows.agg(*(c.cast("long").alias(k) for k, (c, _, _) in bounds.items()))
    out = [F.struct(F.lit(k).alias("name"), F.col(k).alias("n"), F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(k).between(a, b).alias("ok")) for k, (_, a, b) in bounds.items()]
    return n.select(F.inline(F.array(*out)))

"""Self-test of the classification metrics on synthetic scores: a real signal must show, shuffled labels must not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.operators.classification import ranking

#: Digits of a hash that number its bucket: ranks come in two steps, over buckets and in a bucket.
BUCKET_DIGITS = 3


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))


def scored(labelled: DataFrame, separation: float = 0.6, noise: float = 0.1, seed: int = 12345) -> DataFrame:
    """(id, y, score) of labelled rows (id, y): scores around 0.2 and 0.2 + separation, made of hashes, so any partitioning gives the same rows."""
    unit = lambda k: (F.conv(F.substring(_hash(F.lit(seed), F.lit(k), F.col("id")), 1, 13), 16, 10).cast("double") + 1) / float((1 << 52) + 1)
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2))
    return labelled.select("id", F.col("y").cast("int").alias("y"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.2 + separation * F.col("y") + noise * normal)), 9).alias("score"))


def synthetic(spark: SparkSession, n: int = 200, positive: float = 0.4, **how) -> DataFrame:
    """scored() of n rows of which the share ``positive`` is labelled 1."""
    return scored(spark.range(n).withColumn("y", (F.col("id") < round(n * positive)).cast("int")), **how)


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """rows with their rank from 1 in each seed, in the order of a hash of seed and id: counts of buckets first, then ranks in a bucket."""
    h = _hash(F.col("seed"), F.col("id"))
    rows = rows.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, BUCKET_DIGITS))
    counts = rows.groupBy("seed", "__b").agg(F.count("*").alias("__m"))
    before = F.sum("__m").over(W.partitionBy("seed").orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("seed", "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("seed", "__b").orderBy("__h", "id"))
    return rows.withColumn("__r", inside).join(counts, ["seed", "__b"]).withColumn(name, F.col("__before") + F.col("__r")).drop("__h", "__b", "__before", "__r")


def shuffled(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """rows (id, y, score) once for each seed, labels permuted among the ids: the k-th id of one hash gets the label of the k-th of another.

    No task ranks all rows of a seed.  seeds (seed) are few and are sent to the tasks.
    """
    many = rows.join(F.broadcast(seeds))
    labels = _ranked(many.select("seed", "id", "y"), "place").select("seed", "place", "y")
    takers = _ranked(many.select((-F.col("seed")).alias("seed"), "id", "score"), "place").select((-F.col("seed")).alias("seed"), "place", "id", "score")
    return takers.join(labels, ["seed", "place"]).select("seed", "id", "y", "score")


def auc_by_seed(rows: DataFrame) -> DataFrame:
    sliced = rows.select(F.col("id").alias("clip_id"), "score", "y", F.lit("seed").alias("tag"), F.col("seed").cast("string").alias("tag_value"))
    return ranking(sliced).select(F.col("tag_value").cast("int").alias("seed"), "auc_roc")


def run(rows: DataFrame, shuffles: int = 8, base_seed: int = 1000, low: float = 0.85, high: float = 1.001, mean: tuple[float, float] = (0.4, 0.6), margin: float = 0.30) -> DataFrame:
    """One row: baseline, mean of shuffled, the three gates and whether all hold.  Seed 0 is the baseline."""
    spark = rows.sparkSession
    seeds = spark.range(base_seed + 1, base_seed + 1 + shuffles).select(F.col("id").cast("int").alias("seed"))
    both = rows.select(F.lit(0).alias("seed"), "id", "y", "score").unionByName(shuffled(rows, seeds))
    auc = auc_by_seed(both).agg(F.max(F.when(F.col("seed") == 0, F.col("auc_roc"))).alias("baseline"), F.avg(F.when(F.col("seed") != 0, F.col("auc_roc"))).alias("shuffled"))
    gates = {
        "baseline_ok": (F.col("baseline") >= low) & (F.col("baseline") < high), "shuffled_ok": F.col("shuffled").between(*mean),
        "margin_ok": ~(F.col("baseline") - F.col("shuffled") < margin),
    }
    return auc.withColumns(gates).withColumn("passed", F.coalesce(F.col("baseline_ok") & F.col("shuffled_ok") & F.col("margin_ok"), F.lit(False)))

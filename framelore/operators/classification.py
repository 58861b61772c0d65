"""Clip classification metrics, overall and by slice, with typed "not available" values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.functions import fixed
from framelore.functions.na import metric
from framelore.functions.scalars import hard_label
from framelore.operators.quantiles import RANGES, range_of, splitters


def pairing_errors(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (error, clip_id) for clips that occur twice on a side or only on one."""
    def twice(df: DataFrame, what: str) -> DataFrame:
        return df.groupBy("clip_id").count().where("count > 1").select(F.lit(what).alias("error"), "clip_id")

    return (
        twice(predictions, "duplicate_prediction").unionAll(twice(labels, "duplicate_label"))
        .unionAll(predictions.join(labels, "clip_id", "left_anti").select(F.lit("unlabeled_prediction"), "clip_id"))
        .unionAll(labels.join(predictions, "clip_id", "left_anti").select(F.lit("unpredicted_label"), "clip_id"))
    )


def pair(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """predictions (clip_id, score, tags) and labels (clip_id, y, tags) as (clip_id, score, y, tags), checked as they are paired.

    A prediction's tag wins over the label's; null tags are none.  Reading a clip that is null, that occurs twice on a side or only on one
    raises and names it, as does a label other than 0 and 1; pairing_errors() lists them instead.  One shuffle by clip.
    """
    none = F.create_map().cast("map<string,string>")
    tags = lambda df: F.coalesce(F.col("tags").cast("map<string,string>"), none) if "tags" in df.columns else none
    score, y = F.lit(None).cast("double"), F.lit(None).cast("int")
    p = predictions.select("clip_id", F.lit(1).alias("p"), F.lit(0).alias("l"), F.col("score").cast("double").alias("score"), y.alias("y"), tags(predictions).alias("tp"), none.alias("tl"))
    t = labels.select("clip_id", F.lit(0).alias("p"), F.lit(1).alias("l"), score.alias("score"), F.col("y").cast("int").alias("y"), none.alias("tp"), tags(labels).alias("tl"))
    side = lambda name, flag: F.max_by(name, flag)
    g = p.unionAll(t).groupBy("clip_id").agg(F.sum("p").alias("p"), F.sum("l").alias("l"), F.max("score").alias("score"), F.max("y").alias("y"), side("tp", "p").alias("tp"), side("tl", "l").alias("tl"))
    error = (
        F.when(F.col("clip_id").isNull(), "no clip id").when(F.col("p") > 1, "duplicate prediction").when(F.col("l") > 1, "duplicate label")
        .when(F.col("l") == 0, "unlabeled prediction").when(F.col("p") == 0, "unpredicted label").when(~F.coalesce(F.col("y").isin(0, 1), F.lit(False)), "label")
    )
    named = F.raise_error(F.concat(error, F.lit(": "), F.coalesce(F.col("clip_id").cast("string"), F.lit("null")))).cast("boolean")
    only = F.map_filter("tl", lambda k, _: ~F.map_contains_key("tp", k))
    return g.where(F.when(error.isNull(), True).otherwise(named)).select("clip_id", "score", "y", F.map_concat(only, "tp").alias("tags"))


def by_slice(pairs: DataFrame) -> DataFrame:
    """Each row once for the whole (tag and value null) and once for each of its tags."""
    whole = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value")))
    rows = pairs.withColumn("s", F.explode(F.concat(whole, F.map_entries("tags"))))
    return rows.select("clip_id", "score", "y", F.col("s.key").alias("tag"), F.col("s.value").alias("tag_value"))


def confusion(sliced: DataFrame, threshold: float = 0.5) -> DataFrame:
    p = hard_label(F.col("score"), threshold)
    count = lambda y, q, name: F.count_if((F.col("y") == y) & (p == q)).alias(name)
    return sliced.groupBy("tag", "tag_value").agg(
        count(1, 1, "tp"), count(0, 1, "fp"), count(1, 0, "fn"), count(0, 0, "tn"),
        F.count_if(F.col("y") == 1).alias("n_positive"), F.count_if(F.col("y") == 0).alias("n_negative"),
    )


def ranking(sliced: DataFrame, ranges: int = RANGES) -> DataFrame:
    """auc_roc and auprc by slice, exact; null where one class is absent.  Scores may have any scale; null ones are left out.

    Rows are first reduced to distinct scores; the counts of all higher scores come in two steps, over ranges of the
    score that a quantile sketch has cut, and in a range, so no task sees a whole slice.
    """
    keys = ["tag", "tag_value"]
    group = F.xxhash64(F.coalesce("tag", F.lit("\0")), F.coalesce("tag_value", F.lit("\0")))
    sliced = sliced.where("score is not null")
    at = sliced.groupBy(*keys, "score").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    at = at.withColumn("g", group).withColumn("b", range_of(F.col("score"), splitters(sliced, "score", ranges)))
    sums = at.groupBy("g", "b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    higher = W.partitionBy("g").orderBy(F.col("b").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("g")
    sums = sums.select(
        "g", "b", F.coalesce(F.sum("bp").over(higher), F.lit(0)).alias("hp"), F.coalesce(F.sum("bn").over(higher), F.lit(0)).alias("hn"),
        F.sum("bp").over(whole).alias("all_p"), F.sum("bn").over(whole).alias("all_n"),
    )
    upto = W.partitionBy("g", "b").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = at.join(sums, ["g", "b"]).withColumn("cp", F.col("hp") + F.sum("pos").over(upto)).withColumn("cn", F.col("hn") + F.sum("neg").over(upto))
    below = F.col("all_n") - F.col("cn")
    auc = F.sum(F.col("pos") * (below + F.col("neg") / 2.0)) / (F.max("all_p") * F.max("all_n"))
    ap = F.sum(F.col("pos") / F.col("all_p") * (F.col("cp") / (F.col("cp") + F.col("cn"))))
    both = F.col("all_p") * F.col("all_n") > 0
    return rows.where(both).groupBy(*keys).agg(auc.alias("auc_roc"), ap.alias("auprc"))


def metrics(sliced: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per slice: confusion counts and metrics, undefined ones null."""
    c = confusion(sliced, threshold)
    r = ranking(sliced).toDF("__t", "__v", "auc_roc", "auprc")
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", "n_positive")
    f1 = F.when(precision.isNotNull() & recall.isNotNull(), F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0)))
    c = c.join(r, F.col("tag").eqNullSafe(F.col("__t")) & F.col("tag_value").eqNullSafe(F.col("__v")), "left").drop("__t", "__v")
    return c.withColumns({
        "accuracy": F.try_divide(F.col("tp") + F.col("tn"), n), "precision": precision, "recall": recall, "specificity": F.try_divide("tn", "n_negative"), "f1": f1,
    })


def metric_rows(table: DataFrame) -> DataFrame:
    """Fourteen rows (tag, tag_value, name, value, na_reason, higher_is_better) per slice."""
    none = lambda c: F.col(c).isNull()
    rows = [
        metric("accuracy", F.col("accuracy"), [(none("accuracy"), "empty slice")]),
        metric("precision", F.col("precision"), [(none("precision"), fixed.NO_PREDICTED)]),
        metric("recall", F.col("recall"), [(none("recall"), fixed.NO_POSITIVE)]),
        metric("specificity", F.col("specificity"), [(none("specificity"), fixed.NO_NEGATIVE)]),
        metric("f1", F.col("f1"), [(none("f1"), fixed.UNDEFINED)]),
        metric("auc_roc", F.col("auc_roc"), [(none("auc_roc"), fixed.ONE_CLASS)]),
        metric("auprc", F.col("auprc"), [(none("auprc"), fixed.ONE_CLASS)]),
        metric("tn", F.col("tn")), metric("fp", F.col("fp"), higher_is_better=False), metric("fn", F.col("fn"), higher_is_better=False), metric("tp", F.col("tp")),
        metric("n_positive", F.col("n_positive")), metric("n_negative", F.col("n_negative")), metric("total", F.col("n_positive") + F.col("n_negative")),
    ]
    return table.select("tag", "tag_value", F.inline(F.array(*rows)))


def empty_slices(slices: DataFrame, present: DataFrame) -> DataFrame:
    """Metric rows of slices (tag, tag_value) that no clip is in: metrics not available, counts zero."""
    empty = [metric(n, F.lit(None), [(F.lit(True), "empty slice")]) for n in ("accuracy", "precision", "recall", "specificity", "f1", "auc_roc", "auprc")]
    zero = [metric(n, F.lit(0), higher_is_better=n not in ("fp", "fn")) for n in ("tn", "fp", "fn", "tp", "n_positive", "n_negative", "total")]
    same = [slices[c].eqNullSafe(present[c]) for c in ("tag", "tag_value")]
    return slices.join(present, same, "left_anti").select("tag", "tag_value", F.inline(F.array(*empty, *zero)))


def max_pool(windows: DataFrame) -> DataFrame:
    """Per clip the best window score and its position, ties to the first."""
    return windows.groupBy("clip_id").agg(F.max("score").alias("score"), F.max_by("pos", F.struct(F.col("score"), -F.col("pos"))).alias("pos"))


def class_weights(rows: DataFrame, label: Column) -> DataFrame:
    """N / (2 * max(n, 1)) for the labels 0 and 1, those that don't occur too."""
    n = rows.agg(F.count(label).alias("all"), F.count_if(label == 0).alias("n0"), F.count_if(label == 1).alias("n1"))
    weight = lambda c: F.col("all") / (2.0 * F.greatest(F.col(c), F.lit(1)))
    return n.select(F.inline(F.array(*(F.struct(F.lit(k).alias("label"), F.col(f"n{k}").alias("n"), weight(f"n{k}").alias("weight")) for k in (0, 1)))))


def best_epoch(history: DataFrame) -> DataFrame:
    """The epoch with the highest auprc, the first of equals."""
    return history.agg(F.max_by(F.struct("epoch", "auprc"), F.struct(F.col("auprc"), -F.col("epoch"))).alias("b")).select("b.*")


def majority_baseline(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", F.lit(0.0))

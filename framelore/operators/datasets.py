"""The data set of labelled windows: windows of shard members, their labels, splits, batches and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelore.functions.fixed import WINDOW_LABELS

SIDECAR = "clip_id string, label string, frame_index int"


def window_rows(members: DataFrame) -> DataFrame:
    """(clip_key, clip_id, source_label, frame_indices) of shard members (stem, sidecar JSON), one row per window.

    The key is the member's name without its frame offset; indices are in order.  A sidecar that lacks a field is an error.
    """
    rows = members.select(F.regexp_replace("stem", r"_\d+$", "").alias("clip_key"), "stem", F.from_json("sidecar", SIDECAR).alias("s"))
    whole = F.col("s.clip_id").isNotNull() & F.col("s.label").isNotNull() & F.col("s.frame_index").isNotNull()
    rows = rows.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("sidecar lacks a field: "), "stem")).cast("boolean")))
    return rows.groupBy("clip_key").agg(
        F.min("s.clip_id").alias("clip_id"), F.min("s.label").alias("source_label"), F.sort_array(F.collect_list("s.frame_index")).alias("frame_indices")
    )


def label_histogram(windows: DataFrame) -> DataFrame:
    """(label, n) for each of the window labels, 0 where there is none; other labels, null too, count as "other"."""
    other = F.count_if(~F.coalesce(F.col("label").isin(*WINDOW_LABELS), F.lit(False)))
    n = windows.agg(*(F.count_if(F.col("label") == x).alias(x) for x in WINDOW_LABELS), other.alias("other"))
    return n.select(F.inline(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).alias("n")) for x in (*WINDOW_LABELS, "other")))))


def daily_life_falls(windows: DataFrame) -> DataFrame:
    """Windows of a clip without a fall that are labelled fall: there must be none."""
    return windows.where((F.col("source_label") == "no_fall") & (F.col("label") == "fall"))


def usable_windows(windows: DataFrame, lengths: tuple[int, ...] = (16, 32)) -> DataFrame:
    """Windows with length (the first of ``lengths`` that their frames make up) and skipped: why one is left out, else null."""
    n = F.size("frame_indices")
    length = F.coalesce(*(F.when(n == t, F.lit(t)) for t in lengths))
    labelled = F.coalesce(F.col("label").isin("fall", "no_fall"), F.lit(False))
    why = F.when(~labelled, "unlabeled").when(length.isNull(), "length")
    return windows.select("*", length.alias("length"), why.alias("skipped"))


def with_split(windows: DataFrame, splits: DataFrame) -> DataFrame:
    """Windows of clips that have a split (clip_id, split)."""
    return windows.join(splits.select("clip_id", "split"), "clip_id")


def outside_debug(windows: DataFrame, mark: str = "-debug-") -> DataFrame:
    """Windows whose clip isn't of the debug tier by its id; null ids are not."""
    return windows.where(~F.coalesce(F.col("clip_id").contains(mark), F.lit(False)))


def split_distribution(windows: DataFrame) -> DataFrame:
    """(split, windows, clips, fall, no_fall, positive_rate)."""
    fall = F.count_if(F.col("label") == "fall")
    return windows.groupBy("split").agg(
        F.count("*").alias("windows"), F.count_distinct("clip_id").alias("clips"), fall.alias("fall"), F.count_if(F.col("label") == "no_fall").alias("no_fall"),
        (fall / F.count("*")).alias("positive_rate"),
    )


def batches(windows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """The windows of keys (pos, clip_key) with batch, pos // size; each batch lies in one task, in the order of pos.

    Batches are dealt and sorted each alone; nothing is sorted over all.  A key may come several times; missing_keys() has those without a window.
    """
    rows = keys.join(windows, "clip_key").withColumn("batch", F.floor(F.col("pos") / size))
    return rows.repartition("batch").sortWithinPartitions("batch", "pos")


def batch(windows: DataFrame, keys: DataFrame) -> DataFrame:
    """The windows of keys (pos, clip_key), one batch, in the order of pos; for a batch that fits the reader, see batches()."""
    return keys.join(windows, "clip_key").orderBy("pos")


def missing_keys(windows: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(windows, "clip_key", "left_anti")


def both_levels(windows: DataFrame, clips: DataFrame) -> DataFrame:
    """Metric rows of windows and of clips in one table, with their level."""
    return windows.withColumn("level", F.lit("window")).unionByName(clips.withColumn("level", F.lit("clip")))

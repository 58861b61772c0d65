"""Hopping frame windows of tracks with gap, area and side gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.functions.scalars import area, shorter_side

BOX = ("x_min", "y_min", "x_max", "y_max")


def last_box_wins(boxes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One box per track and frame: the last in input order, by a reduction that needs no sort."""
    rest = [c for c in boxes.columns if c not in (*keys, "frame_index", "ord")]
    best = boxes.groupBy(*keys, "frame_index").agg(F.max_by(F.struct(*rest), F.col("ord")).alias("b"), F.max("ord").alias("ord"))
    return best.select(*keys, "frame_index", "ord", "b.*")


def candidates(
    boxes: DataFrame, keys: tuple[str, ...] = ("clip_id", "track_id"), length: int = 32, stride: int | None = None, gap_tolerance: int = 4,
    min_area: float = 1024.0, min_side: float = 16.0, max_windows: int = 8,
) -> DataFrame:
    """Candidate windows in order with their reason (null: emitted) and, for emitted ones, their index.

    Windows start at first + k * stride up to the track's last frame.  A box knows the windows that it is in, so boxes
    are dealt to windows by an equi-join key and reduced there, without a range join.  Reasons in order: longest run of
    missing frames above the tolerance; mean area, then median shorter side, of the real boxes too small.  The scan
    ends with the max_windows-th emitted window.
    """
    stride = stride or length
    one = last_box_wins(boxes, keys)
    ends = one.groupBy(*keys).agg(F.min("frame_index").cast("long").alias("first"), F.max("frame_index").cast("long").alias("last"))
    at = F.col("frame_index") - F.col("first")
    low = F.greatest(F.lit(0).cast("long"), F.ceil((at - length + 1) / stride))
    dealt = one.join(ends, list(keys)).withColumn("low", low).withColumn("high", F.floor(at / stride)).where("low <= high")
    dealt = dealt.withColumn("k", F.explode(F.sequence("low", "high")))
    offset = (F.col("frame_index") - F.col("first") - F.col("k") * stride).cast("int")
    box = [F.col(c) for c in BOX]
    seen = dealt.groupBy(*keys, "k").agg(
        F.sort_array(F.collect_list(offset)).alias("o"), F.avg(area(*box)).alias("mean_area"), F.percentile(shorter_side(*box), F.lit(0.5)).alias("median_side")
    )
    starts = ends.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first")) / stride))))
    all_ = starts.join(seen, [*keys, "k"], "left").withColumn("o", F.coalesce("o", F.array().cast("array<int>")))
    whole = F.concat(F.array(F.lit(-1)), F.col("o"), F.array(F.lit(length)))
    runs = F.transform(F.sequence(F.lit(2), F.size(whole)), lambda i: F.element_at(whole, i) - F.element_at(whole, i - 1) - 1)
    reason = (
        F.when(F.array_max(runs) > gap_tolerance, "too_many_gaps").when(F.size("o") == 0, "insufficient_coverage")
        .when(F.col("mean_area") < min_area, "insufficient_coverage").when(F.col("median_side") < min_side, "insufficient_coverage")
    )
    everything = F.sequence(F.lit(0), F.lit(length - 1))
    rows = all_.select(
        *keys, "k", (F.col("first") + F.col("k") * stride).alias("start_frame"), reason.alias("reason"), "o",
        F.array_except(everything, F.col("o")).alias("missing_offsets"), (F.size("o") / length).alias("coverage"),
    )
    before = W.partitionBy(*keys).orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("emitted_before", F.coalesce(F.sum(F.col("reason").isNull().cast("int")).over(before), F.lit(0)))
    rows = rows.where(F.col("emitted_before") < max_windows)
    return rows.select(
        *keys, F.col("k").alias("candidate"), "start_frame", "reason", F.when(F.col("reason").isNull(), F.col("emitted_before")).alias("window_index"),
        F.when(F.col("reason").isNull(), F.col("missing_offsets")).alias("missing_offsets"), F.when(F.col("reason").isNull(), F.col("coverage")).alias("coverage"),
    )


def dense_boxes(boxes: DataFrame, emitted: DataFrame, keys: tuple[str, ...] = ("clip_id", "track_id"), length: int = 32) -> DataFrame:
    """Each offset of each emitted window with its box, or the last one before it in the window, or zeros."""
    one = last_box_wins(boxes, keys).select(*keys, F.col("frame_index").cast("long").alias("frame_index"), F.struct(*BOX, "confidence").alias("box"))
    slots = emitted.where("reason is null").select(*keys, "window_index", "start_frame", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("frame_offset"))
    slots = slots.withColumn("frame_index", F.col("start_frame") + F.col("frame_offset"))
    seen = slots.join(one, [*keys, "frame_index"], "left")
    upto = W.partitionBy(*keys, "window_index").orderBy("frame_offset").rowsBetween(W.unboundedPreceding, 0)
    carried = F.last("box", ignorenulls=True).over(upto)
    zero = F.struct(*(F.lit(0.0).alias(c) for c in (*BOX, "confidence")))
    return seen.withColumn("missing_frame", F.col("box").isNull()).withColumn("b", F.coalesce(carried, zero)).select(
        *keys, "window_index", "frame_offset", "frame_index", "missing_frame", "b.*"
    )


def skip_histogram(windows: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    return windows.groupBy(*groups, F.coalesce("reason", F.lit("emitted")).alias("reason")).agg(F.count("*").alias("n"))


def run_summary(windows: DataFrame, keys: tuple[str, ...] = ("clip_id", "track_id")) -> DataFrame:
    """One row: clips, tracks, emitted and skipped windows."""
    tracks = windows.groupBy(*keys).agg(F.count_if(F.col("reason").isNull()).alias("emitted"), F.count_if(F.col("reason").isNotNull()).alias("skipped"))
    return tracks.agg(
        F.count_distinct(keys[0]).alias("clips"), F.count("*").alias("tracks"), F.coalesce(F.sum("emitted"), F.lit(0)).alias("emitted"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped")
    )


def completeness(dense: DataFrame) -> DataFrame:
    """(clip_id, track_id, window_index, length, missing, is_complete) of dense_boxes(): a window without a filled frame is complete."""
    missing = F.count_if("missing_frame")
    return dense.groupBy("clip_id", "track_id", "window_index").agg(F.count("*").alias("length"), missing.alias("missing"), (missing == 0).alias("is_complete"))

"""Track analytics over detections (clip_id, ord, frame_index, track_id, confidence, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.functions.scalars import latency_ms, rate


def segments(detections: DataFrame) -> DataFrame:
    """Runs of consecutive frames of a track, in input order: (clip_id, track_id, segment, start, end, frames)."""
    w = W.partitionBy("clip_id", "track_id").orderBy("ord")
    new = F.coalesce((F.col("frame_index") != F.lag("frame_index").over(w) + 1).cast("int"), F.lit(1))
    rows = detections.where("track_id is not null").withColumn("new", new)
    rows = rows.withColumn("segment", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("clip_id", "track_id", "segment").agg(
        F.min("frame_index").alias("start"), F.max("frame_index").alias("end"), F.count("*").alias("frames")
    )


def fragmentation(parts: DataFrame) -> DataFrame:
    """Per track: number of segments, frames, longest segment."""
    return parts.groupBy("clip_id", "track_id").agg(
        F.count("*").alias("segments"), F.sum("frames").alias("total_frames"), F.max("frames").alias("longest_segment")
    )


def track_summaries(detections: DataFrame) -> DataFrame:
    """Per track: its frames in order with their confidences, first and last frame, length."""
    rows = F.sort_array(F.collect_list(F.struct("ord", "frame_index", "confidence")))
    out = detections.where("track_id is not null").groupBy("clip_id", "track_id").agg(rows.alias("r"))
    frames = F.transform("r", lambda x: x["frame_index"])
    return out.select(
        "clip_id", "track_id", frames.alias("frame_indices"), F.transform("r", lambda x: x["confidence"]).alias("confidences"),
        F.get(frames, F.lit(0)).alias("first_frame"), F.element_at(frames, -1).alias("last_frame"), F.size("r").alias("length"),
    )


def longest_track(detections: DataFrame) -> DataFrame:
    """Per clip the track with most detections, ties to the smaller id."""
    n = detections.where("track_id is not null").groupBy("clip_id", "track_id").agg(F.count("*").alias("length"))
    return n.groupBy("clip_id").agg(F.max_by(F.struct("track_id", "length"), F.struct(F.col("length"), -F.col("track_id"))).alias("t")).select("clip_id", "t.*")


def dominant_tracks(detections: DataFrame, key: str = "track_id") -> DataFrame:
    """(clip_id, frame_index, dominant) for frames 0 to the clip's last: the key with most detections, ties to the first seen.

    Frames without a tracked detection have null; the timeline's length counts all detections.
    """
    n = detections.where(F.col(key).isNotNull()).groupBy("clip_id", "frame_index", key).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = n.groupBy("clip_id", "frame_index").agg(F.max_by(F.col(key), F.struct(F.col("n"), -F.col("first"))).alias("dominant"))
    length = detections.groupBy("clip_id").agg(F.max("frame_index").alias("last"))
    timeline = length.select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("frame_index"))
    return timeline.join(best, ["clip_id", "frame_index"], "left")


def switches(timeline: DataFrame) -> DataFrame:
    """Per clip: changes between consecutive dominant tracks; frames without one are bridged."""
    before = F.lag("dominant").over(W.partitionBy("clip_id").orderBy("frame_index"))
    rows = timeline.where("dominant is not null").withColumn("before", before)
    changes = rows.groupBy("clip_id").agg(F.count_if(F.col("dominant") != F.col("before")).alias("switches"))
    return timeline.select("clip_id").distinct().join(changes, "clip_id", "left").select("clip_id", F.coalesce("switches", F.lit(0)).alias("switches"))


def primary_track(timeline: DataFrame) -> DataFrame:
    """Per clip the most frequent dominant track, ties to the one seen first."""
    n = timeline.where("dominant is not null").groupBy("clip_id", "dominant").agg(F.count("*").alias("n"), F.min("frame_index").alias("first"))
    return n.groupBy("clip_id").agg(F.max_by("dominant", F.struct(F.col("n"), -F.col("first"))).alias("primary_track"))


def densify(rows: DataFrame, key: str, bucket: str, last: int | None = None) -> DataFrame:
    """Rows per key and bucket 0..last, by default each key's own last one, empty buckets with 0; rows outside are left out."""
    n = rows.where(F.col(bucket) >= 0).groupBy(key, bucket).agg(F.count("*").alias("n"))
    end = F.max(bucket) if last is None else F.lit(last)
    frame = rows.groupBy(key).agg(end.cast("long").alias("__end")).where("__end >= 0").select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__end"))).alias(bucket))
    return frame.join(n, [key, bucket], "left").select(key, bucket, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def continuity_report(detections: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per clip of runs (clip_id, frames, elapsed_sec): the track metrics and speed."""
    timeline = dominant_tracks(detections)
    tracks = detections.where("track_id is not null").groupBy("clip_id").agg(F.count_distinct("track_id").alias("n_tracks"))
    parts = [tracks, longest_track(detections).withColumnsRenamed({"track_id": "longest_track", "length": "longest_length"}), switches(timeline), primary_track(timeline)]
    out = runs
    for part in parts:
        out = out.join(part, "clip_id", "left")
    fps, ms = rate(F.col("frames"), F.col("elapsed_sec")), latency_ms(F.col("frames"), F.col("elapsed_sec"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_tracks", "switches")}
    return out.withColumns(zero | {"fps": fps, "latency_ms": ms})


def report_json(report: DataFrame, fragments: DataFrame) -> DataFrame:
    """(clip_id, value): continuity_report() rows as JSON, each with its tracks' fragmentation rows (clip_id, track_id, ...) by track."""
    rows = fragments.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in fragments.columns if c != "clip_id")))).alias("fragmentation"))
    both = report.join(rows, "clip_id", "left")
    return both.select("clip_id", F.to_json(F.struct(*report.columns, F.coalesce("fragmentation", F.array().cast(rows.schema["fragmentation"].dataType)).alias("fragmentation")), {"ignoreNullFields": "false"}).alias("value"))

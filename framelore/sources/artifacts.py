"""What a perception run leaves behind: detector output as rows, JSON by clip, the summary of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("detections", "tracks", "report", "run_meta")
#: Frames of a clip that a task writes.
FRAMES = 1 << 17


def flatten_detections(results: DataFrame, person: int = 0) -> DataFrame:
    """Boxes of detector output (clip_id, frame_index, xyxy, conf, cls, ids arrays): one row for each box of a person.

    A frame whose arrays are missing or don't fit together has decoded_ok false; it and a frame without persons give one
    row with null box.  ids may be missing or short: the track is null then.
    """
    n = F.size("xyxy")
    fits = (F.size("conf") >= n) & (F.size("cls") >= n) & F.forall("xyxy", lambda b: F.coalesce(F.size(b) == 4, F.lit(False)))
    whole = F.forall(F.slice("conf", 1, n), lambda c: c.isNotNull()) & F.forall(F.slice("cls", 1, n), lambda c: c.isNotNull())
    ok = F.coalesce(F.col("xyxy").isNotNull() & F.col("conf").isNotNull() & F.col("cls").isNotNull() & fits & whole, F.lit(False))

    def box(b: Column, i: Column) -> Column:
        at = lambda name: F.get(F.col(name), i)
        corner = lambda k, name: F.get(b, F.lit(k)).cast("double").alias(name)
        track = F.get(F.coalesce(F.col("ids"), F.array().cast("array<int>")), i)
        return F.struct(
            i.alias("ord"), track.cast("int").alias("track_id"), at("cls").cast("int").alias("cls_id"), at("conf").cast("double").alias("confidence"),
            corner(0, "x_min"), corner(1, "y_min"), corner(2, "x_max"), corner(3, "y_max"),
        )

    boxes = F.filter(F.transform("xyxy", box), lambda x: x["cls_id"] == person)
    rows = results.select("clip_id", "frame_index", ok.alias("decoded_ok"), F.explode_outer(F.when(ok, boxes)).alias("b"))
    return rows.select("clip_id", "frame_index", "decoded_ok", "b.*")


def write_artifacts(path: str, **tables: DataFrame) -> dict[str, str]:
    """Write detections, tracks, report and run_meta as JSON, a folder for each clip_id; the path of each by name.

    Tables are dealt by clip and, where they have frames, by stretches of FRAMES of them, so that a large clip is written by
    several tasks, a file each; what a run wrote before is replaced.
    """
    unknown = set(tables) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown artefacts: {sorted(unknown)}")
    out = {}
    for name, table in tables.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        dealt = [F.col("clip_id"), F.floor(F.col("frame_index") / FRAMES)] if "frame_index" in table.columns else [F.col("clip_id")]
        table.repartition(*dealt).write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy("clip_id").json(out[name])
    return out


def run_meta(detections: DataFrame, runs: DataFrame) -> DataFrame:
    """runs (clip_id, frame_count, decode_failures, elapsed_seconds) with counts of boxes and tracks, fps, milliseconds a frame."""
    n = detections.groupBy("clip_id").agg(F.count("ord").alias("detection_count"), F.count_distinct("track_id").alias("track_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return runs.join(n, "clip_id", "left").select(
        *runs.columns, zero("detection_count"), zero("track_count"), F.try_divide("frame_count", "elapsed_seconds").alias("fps"),
        (F.try_divide("elapsed_seconds", "frame_count") * 1000).alias("latency_ms_per_frame"),
    )


def run_summary(clips: DataFrame) -> DataFrame:
    """One row of JSON over clips (clip_id, windows, error): how many were done, failed and without windows, and the failures."""
    failed = F.col("error").isNotNull()
    s = clips.agg(
        F.count("*").alias("clips"), F.count_if(failed).alias("failed"), F.count_if(~failed & (F.coalesce("windows", F.lit(0)) == 0)).alias("empty"),
        F.coalesce(F.sum("windows"), F.lit(0)).alias("windows"), F.sort_array(F.collect_list(F.when(failed, F.struct("clip_id", "error")))).alias("errors"),
    )
    return s.select(F.to_json(F.struct("*")).alias("value"))


def write_run_summary(clips: DataFrame, path: str) -> str:
    run_summary(clips).write.mode("overwrite").text(path)
    return path


def fallback_used(low_threshold: Column, tracker: Column, end_to_end: Column) -> Column:
    """The fallback levers of a run as one text, those that need a hand last; null without any."""
    text = F.concat_ws(
        ", ", F.concat(F.lit("track_low_thresh="), low_threshold.cast("string")), F.concat(F.lit("tracker="), tracker),
        F.concat(F.lit("end2end="), end_to_end.cast("string"), F.lit(" (manual intervention required)")),
    )
    return F.nullif(text, F.lit(""))

"""Stand-in views: track boxes, score streams, intervals, clips and label series made of the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_of(ts) -> F.Column:
    """Half-days since 2024-01-01, whatever the session's time zone."""
    return F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 43200).cast("long")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clip; a user is a track, a half-day a frame, the event's value the box's width."""
    e = table(spark, sf_dir, "events")
    x, y = F.pmod(F.col("event_id") * 13, F.lit(600)).cast("double"), F.pmod(F.col("event_id") * 7, F.lit(440)).cast("double")
    return e.select(
        F.pmod("user_id", F.lit(5)).alias("clip_id"), F.col("user_id").alias("track_id"), frame_of("ts").alias("frame_index"), F.col("event_id").alias("ord"), "event_type",
        x.alias("x_min"), y.alias("y_min"), (x + F.col("value")).alias("x_max"), (y + F.col("value") * 1.5).alias("y_max"), F.lit(1.0).alias("confidence"),
    )


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a clip, its events in order are the frames."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("clip_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"), "event_type")


def intervals(scores: DataFrame) -> DataFrame:
    """Runs of two or more frames whose event is an error or a purchase."""
    hits = scores.where(F.col("event_type").isin("error", "purchase"))
    hits = hits.withColumn("g", F.col("pos") - F.row_number().over(W.partitionBy("clip_id").orderBy("pos")))
    runs = hits.groupBy("clip_id", "g").agg(F.min("pos").alias("start_frame"), F.max("pos").alias("end_frame"), F.count("*").alias("n")).where("n >= 2")
    return runs.select("clip_id", F.row_number().over(W.partitionBy("clip_id").orderBy("start_frame")).alias("ord"), "start_frame", "end_frame")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    r = F.pmod("doc_id", F.lit(10))
    return d.join(l.select("doc_id", "quality", "toxic"), "doc_id", "left").select(
        F.col("doc_id").alias("clip_id"), F.col("source").alias("dataset"), F.col("lang").alias("lighting"), F.md5(F.col("text").cast("binary")).alias("source_path"),
        F.when(F.col("source") != "src0", F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4).cast("string"))).alias("subject_id"), F.when(r <= 6, "train").when(r <= 8, "validate").otherwise("debug").alias("role"),
        F.col("quality").alias("y"), (F.pmod(F.col("n_chars") * 37, F.lit(101)) / 100.0).alias("score"), F.col("doc_id").alias("pos"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).otherwise(-1)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sequence"), F.col("l_linenumber").alias("frame_number"), label.alias("label"))


#: The same views in DuckDB's SQL.
SQL = """
det as (select user_id % 5 clip_id, user_id track_id, cast(floor(epoch(ts) / 43200) as bigint) - 39446 frame_index, event_id ord, event_type,
  cast((event_id * 13) % 600 as double) x_min, cast((event_id * 7) % 440 as double) y_min,
  cast((event_id * 13) % 600 as double) + value x_max, cast((event_id * 7) % 440 as double) + value * 1.5 y_max, 1.0::double confidence from events),
stream as (select user_id clip_id, row_number() over (partition by user_id order by ts, event_id) - 1 pos, least(1.0, value / 100) score, event_type from events),
gt0 as (select clip_id, pos, pos - row_number() over (partition by clip_id order by pos) g from stream where event_type in ('error', 'purchase')),
gt1 as (select clip_id, min(pos) start_frame, max(pos) end_frame from gt0 group by clip_id, g having count(*) >= 2),
gt as (select clip_id, row_number() over (partition by clip_id order by start_frame) ord, start_frame, end_frame from gt1),
clips as (select d.doc_id clip_id, source dataset, lang lighting, md5(text) source_path, case when source <> 'src0' then 'p' || (d.doc_id // 4) end subject_id,
  case when d.doc_id % 10 <= 6 then 'train' when d.doc_id % 10 <= 8 then 'validate' else 'debug' end as role, quality y, ((n_chars * 37) % 101) / 100.0 score, d.doc_id pos
  from documents d left join labels l on d.doc_id = l.doc_id),
frames as (select l_orderkey sequence, l_linenumber frame_number, case l_returnflag when 'R' then 1 when 'A' then 0 else -1 end as label from lineitem)
"""

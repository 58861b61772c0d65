"""Tar shards of window frames: images with their sidecars, window keys and checks of sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore.sources.archives import MANIFEST, directory, images, read_index, read_members, write_shards

__all__ = ["clip_keys", "missing_keys", "missing_sidecars", "read_index", "read_shards", "window_frames", "write_shards"]


def _read(places: DataFrame) -> DataFrame:
    return read_members(places).withColumn("shard", F.substring_index("path", "/", -1))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, member, stem, data, sidecar) of the images of tar archives, each with its JSON sidecar, null where it has none.

    Headers are read first; the bytes of images and sidecars are then fetched by ranges, so no archive is held.
    """
    return _read(images(directory(spark, path))).select("shard", "member", "stem", "data", "sidecar")


def window_frames(members: DataFrame, keys: DataFrame) -> DataFrame:
    """(clip_key, frame_offset, shard, member, data, sidecar, fetched) of the windows keys (clip_key) only.

    members: a directory of archives, whose images' stems are key_NNNN.  Windows are found by key in the directory, then
    only their ranges of bytes are read.
    """
    found = images(members).withColumns({"clip_key": F.regexp_replace("stem", r"_\d+$", ""), "frame_offset": F.regexp_extract("stem", r"_(\d+)$", 1).try_cast("int")})
    wanted = found.join(keys.select("clip_key").distinct(), "clip_key", "left_semi")
    return _read(wanted).select("clip_key", "frame_offset", "shard", "member", "data", "sidecar", "fetched")


def clip_keys(spark: SparkSession, path: str) -> DataFrame:
    """(shard, clip_key) from the archives' own manifests; nothing else of an archive is read but its headers."""
    manifests = _read(directory(spark, path).where(F.col("member") == MANIFEST).select("path", "offset", "size"))
    text = F.from_json(F.col("data").cast("string"), "clip_keys array<string>")["clip_keys"]
    return manifests.select("shard", F.explode(text).alias("clip_key"))


def missing_sidecars(members: DataFrame) -> DataFrame:
    return members.where("sidecar is null").select("shard", "member")


def missing_keys(members: DataFrame, required: tuple[str, ...] = ("clip_id", "dataset", "label", "source_path", "track_id", "frame_index", "frame_offset")) -> DataFrame:
    """(member, missing): sidecars that lack a required field."""
    value = lambda k: F.get_json_object("sidecar", f"$.{k}")
    lacking = F.array_compact(F.array(*(F.when(value(k).isNull(), F.lit(k)) for k in required)))
    return members.select("member", lacking.alias("missing")).where(F.size("missing") > 0)

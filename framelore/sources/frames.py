"""Frames that windows need: which they are, where a copy of each lies, and their bytes without the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelore.sources.archives import read_members
from framelore.sources.manifests import order_frames

KEY = ["clip_id", "frame_index"]
PLACE = "path string, offset long, size long"


def needed_frames(windows: DataFrame) -> DataFrame:
    """(clip_id, frame_index), each once, of windows (clip_id, frame_indices); null indices name no frame."""
    return windows.select("clip_id", F.explode(F.col("frame_indices").cast("array<long>")).alias("frame_index")).where("frame_index is not null").distinct()


def file_frames(files: DataFrame) -> DataFrame:
    """(clip_id, frame_index, path, offset, size) of frame folders: files (path, length) of which the folder is the clip.

    Frames count from 0 in the order of the numbers at the end of their names.
    """
    parts = files.withColumns({"clip_id": F.element_at(F.split("path", "/"), -2), "name": F.substring_index("path", "/", -1)})
    rows = order_frames(parts, "clip_id", "name")
    return rows.select("clip_id", F.col("frame_index").cast("long").alias("frame_index"), "path", F.lit(0).cast("long").alias("offset"), F.col("length").alias("size"))


def staged_frames(files: DataFrame, prefix: str = "crops_") -> DataFrame:
    """As file_frames(), of local copies <prefix><clip>/frame_NNNNN.png: the number in the name is the index."""
    folder = F.element_at(F.split("path", "/"), -2)
    index = F.regexp_extract("path", r"/frame_(\d+)\.png$", 1).try_cast("long")
    rows = files.select(F.regexp_replace(folder, f"^{prefix}", "").alias("clip_id"), index.alias("frame_index"), "path", F.lit(0).cast("long").alias("offset"), F.col("length").alias("size"))
    return rows.where("frame_index is not null")


def locate(needed: DataFrame, *copies: DataFrame) -> DataFrame:
    """needed with copy, path, offset and size: the first of ``copies`` (clip_id, frame_index, path, offset, size) that has the frame.

    copy is its number from 0; all four are null where none has it.  Of several files of a copy the first by path counts.
    The copies are filtered by what is needed before they are reduced to one row a frame.
    """
    rows = None
    for number, copy in enumerate(copies):
        one = copy.select("clip_id", F.col("frame_index").cast("long").alias("frame_index"), F.struct(F.lit(number).alias("copy"), "path", "offset", "size").alias("at"))
        rows = one if rows is None else rows.unionByName(one)
    best = rows.join(needed.select(KEY), KEY, "left_semi").groupBy(KEY).agg(F.min("at").alias("at"))
    return needed.join(best, KEY, "left").select(*needed.columns, "at.copy", "at.path", "at.offset", "at.size")


def missing_frames(located: DataFrame) -> DataFrame:
    return located.where("path is null").select(KEY)


def fetch(located: DataFrame, tasks: int | None = None) -> DataFrame:
    """located frames with data and fetched, the bytes read for them; frames that no copy has are left out, see missing_frames()."""
    return read_members(located.where("path is not null"), tasks).drop("sidecar")

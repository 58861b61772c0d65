"""Manifests, label files, annotations and frame folders as DataFrames with explicit schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.functions import fixed
from framelore.functions.scalars import clip_folder, clip_id_of_folder, stem, trailing_number
from framelore.operators.manifest import validate

CLIP = (
    "clip_id string, dataset string, role string, label string, source_path string, subject_id string, duration_sec double, frame_count int, "
    "notes string, lighting string, occlusion string, multi_person boolean, action_confuser string"
)
MANIFEST = f"schema_version string, clips array<struct<{CLIP.replace(' ', ':').replace(',:', ',')}>>"
DETECTION = "clip_id string, ord long, frame_index int, track_id int, cls_id int, confidence double, x_min double, y_min double, x_max double, y_max double"


def _yaml_to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each YAML document as JSON, read in the task that has the file."""
    for pdf in batches:
        found = [yaml.safe_load(text) for text in pdf["value"]]
        wrong = [type(x).__name__ for x in found if not isinstance(x, dict)]
        if wrong:
            raise ValueError(f"a manifest is a mapping, not {wrong[0]}")
        yield pd.DataFrame({"value": [json.dumps(x, default=str) for x in found]})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Clips of a JSON or YAML manifest with schema_version and pos, the place in the list."""
    if path.endswith((".yaml", ".yml")):
        texts = spark.read.text(path, wholetext=True).mapInPandas(_yaml_to_json, "value string")
        whole = texts.select(F.from_json("value", MANIFEST).alias("m")).select("m.*")
    else:
        whole = spark.read.schema(MANIFEST).json(path, multiLine=True)
    clips = F.coalesce("clips", F.raise_error(F.lit("a manifest needs a list of clips")).cast(whole.schema["clips"].dataType))
    return whole.select("schema_version", F.posexplode(clips).alias("pos", "c")).select("schema_version", "pos", "c.*")


def manifest_json(clips: DataFrame) -> DataFrame:
    """One row per schema version: the manifest as JSON, clips in the order of pos."""
    names = [c.split()[0] for c in CLIP.split(", ")]
    rows = F.sort_array(F.collect_list(F.struct("pos", F.struct(*names).alias("c"))))
    return clips.groupBy("schema_version").agg(rows.alias("r")).select(
        F.to_json(F.struct("schema_version", F.transform("r", lambda x: x["c"]).alias("clips")), {"ignoreNullFields": "false"}).alias("value")
    )


def write_manifest(clips: DataFrame, path: str) -> str:
    """Write the manifest of validated clips as text that is JSON and YAML both; clips in the order of pos.

    One document is one row, which has to fit a task; for registries that do not, write_clips() writes lines.
    """
    manifest_json(clips).coalesce(1).write.mode("overwrite").text(path)
    return path


def write_clips(clips: DataFrame, path: str) -> str:
    """Write clips as JSON lines, each task its own, null fields included; what lay there is replaced."""
    clips.select("schema_version", "pos", *(c.split()[0] for c in CLIP.split(", "))).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """Clips that write_clips() wrote, as read_manifest() gives them; their place is pos."""
    return spark.read.schema(f"schema_version string, pos string, {CLIP}").json(path)


def build_manifest(folders: DataFrame, version: str = "1.1", **how) -> DataFrame:
    """The manifest's rows of clip folders, validated: no clip at all, or an error of validate(), raises."""
    clips = clips_from_folders(folders, **how)
    named = [c.split() for c in CLIP.split(", ")]
    clips = clips.select(*((F.col(n) if n in clips.columns else F.lit(None)).cast(t).alias(n) for n, t in named))
    clips = clips.withColumns({"schema_version": F.lit(version), "pos": F.col("clip_id")})
    errors = validate(clips, version).where("severity = 'error'").limit(20).collect()
    if errors or clips.isEmpty():
        raise ValueError(f"not a valid manifest: {[(e.rule, e.key) for e in errors] or 'no clip folders'}")
    return clips


def expected_files(spark: SparkSession, root: str, labels: str, marker: str, label_files: tuple[str, ...]) -> DataFrame:
    """(path): everything that a complete copy of the public data set's first camera has: marker, label files, clip folders."""
    fixed_ones = [(f"{root.rstrip('/')}/{marker}",)] + [(f"{labels.rstrip('/')}/{f}",) for f in label_files]
    folders = expected_archives(spark, "").select(F.concat(F.lit(root.rstrip("/") + "/"), "folder").alias("path"))
    return spark.createDataFrame(fixed_ones, "path string").unionAll(folders)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, fields) of label files without a header; blank lines are left out."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    return text.where(F.trim("line") != "").select("file", (F.col("n") + 1).alias("line_number"), F.split("line", ",").alias("fields"))


def frame_labels(lines: DataFrame) -> DataFrame:
    """(sequence, frame_number, label) of well-formed lines; labels.rejects() names the others."""
    get = lambda i: F.trim(F.get("fields", F.lit(i)))
    rows = lines.where(F.size("fields") >= 3).select(get(0).alias("sequence"), get(1).try_cast("int").alias("frame_number"), get(2).try_cast("int").alias("label"))
    return rows.where((F.col("sequence") != "") & (F.col("frame_number") >= 1) & F.col("label").isin(*fixed.FRAME_LABELS))


def parse_annotation(text: Column, frame_size: tuple[int, int] | None = None) -> tuple[Column, Column]:
    """(event struct(start, end, error), detections array) of an annotation text.

    Lines 1 and 2 are the event (0 and 0: none), each other line frame, flag, x1, y1, x2, y2; blank lines don't count.
    With frame_size (width, height), a box beyond it is an error.
    """
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
    number = lambda i: F.trim(F.get(lines, F.lit(i))).try_cast("int")
    a, b = number(0), number(1)
    error = (
        F.when(F.size(lines) < 2, "too few lines").when(a.isNull() | b.isNull(), "not an integer").when((a == 0) & (b == 0), None)
        .when((a == 0) | (b == 0), "one bound is zero").when(a > b, "inverted").when(a < 1, "negative")
    )
    good = error.isNull() & ~((a == 0) & (b == 0))

    def detection(line: Column) -> Column:
        v = F.transform(F.split(line, ","), lambda x: F.trim(x).try_cast("int"))
        g = lambda i: F.get(v, F.lit(i))
        present = ~((g(2) == 0) & (g(3) == 0) & (g(4) == 0) & (g(5) == 0))
        wrong = (
            F.when(F.size(v) != 6, "columns").when(F.exists(v, lambda x: x.isNull()), "not an integer").when(g(0) < 1, "frame")
            .when(present & ((g(2) >= g(4)) | (g(3) >= g(5))), "box")
        )
        if frame_size:
            wrong = F.coalesce(wrong, F.when(present & ((g(4) > frame_size[0]) | (g(5) > frame_size[1])), "outside"))
        names = ("frame_index", "flag", "x1", "y1", "x2", "y2")
        return F.struct(*(g(i).alias(n) for i, n in enumerate(names)), present.alias("present"), wrong.alias("error"))

    event = F.struct(F.when(good, a).alias("start"), F.when(good, b).alias("end"), error.alias("error"))
    return event, F.transform(F.slice(lines, 3, 1 << 30), detection)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length")


def order_frames(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """Frames of each folder numbered from 0: by the number at the end of the name, then name; names without one come last."""
    number = trailing_number(stem(F.col(name)))
    rows = files.where(F.lower(F.substring_index(name, ".", -1)).isin(*fixed.FRAME_EXTENSIONS)).withColumn("source_index", number)
    order = W.partitionBy(folder).orderBy((F.col("source_index") < 0), "source_index", name)
    return rows.withColumn("frame_index", F.row_number().over(order) - 1)


def folder_entries(files: DataFrame, root: str) -> DataFrame:
    """(clip, depth, child, name) of files (path) below root/<clip>: depth 0 in the clip's folder, 1 in a child of it, and so on."""
    below = F.regexp_replace(F.element_at(F.split("path", rf"\Q{root.rstrip('/')}/\E", 2), -1), "^/+", "")
    rows = files.where(F.contains("path", F.lit(root.rstrip("/") + "/"))).withColumn("p", F.split(below, "/")).where(F.size("p") > 1)
    return rows.select(F.get("p", F.lit(0)).alias("clip"), (F.size("p") - 2).alias("depth"), F.when(F.size("p") > 2, F.get("p", F.lit(1))).alias("child"), F.element_at("p", -1).alias("name"))


def frame_layout(entries: DataFrame) -> DataFrame:
    """(clip, layout, frames) of entries (clip, depth, child, name): where a clip's frames are read from, and how many there are.

    flat: in its folder; nested:<child>: in the only child folder, if there are none in the folder itself; missing: nowhere, which
    several children, or deeper frames only, are too.
    """
    frame = F.lower(F.substring_index("name", ".", -1)).isin(*fixed.FRAME_EXTENSIONS) & F.contains("name", F.lit("."))
    g = entries.groupBy("clip").agg(
        F.count_if((F.col("depth") == 0) & frame).alias("flat"), F.count_if((F.col("depth") == 1) & frame).alias("below"),
        F.count_distinct("child").alias("children"), F.min("child").alias("c"),
    )
    nested = (F.col("children") == 1) & (F.col("below") > 0)
    layout = F.when(F.col("flat") > 0, "flat").when(nested, F.concat(F.lit("nested:"), "c")).otherwise("missing")
    return g.select("clip", layout.alias("layout"), F.when(F.col("flat") > 0, F.col("flat")).when(nested, F.col("below")).otherwise(0).alias("frames"))


def label_files(files: DataFrame, folder: str) -> DataFrame:
    """(name, path) of the CSV files (path) that lie in a folder itself, whatever the case of their ending."""
    inside = F.substring_index("path", "/", -1)
    rows = files.where((F.col("path") == F.concat(F.lit(folder.rstrip("/") + "/"), inside)) & F.lower("path").endswith(".csv"))
    return rows.select(inside.alias("name"), "path")


def clips_from_folders(folders: DataFrame, dataset: str = "urfd", role: str = "debug", root: str = "datasets/urfd/") -> DataFrame:
    """Clip rows of folders (folder): names that parse, copies of a name once (the first by name)."""
    p = folders.withColumn("p", clip_folder(F.col("folder"))).where("p is not null")
    one = p.groupBy(F.col("p.name").alias("name")).agg(F.min_by("p", "folder").alias("p"), F.min("folder").alias("folder"))
    notes = F.concat_ws("; ", F.concat(F.lit("sequence="), F.col("p.sequence")), F.concat(F.lit("camera="), F.col("p.camera")), F.lit("frame-folder (PNGs)"))
    return one.select(
        clip_id_of_folder(F.col("name")).alias("clip_id"), F.lit(dataset).alias("dataset"), F.lit(role).alias("role"), F.col("p.label").alias("label"),
        F.concat(F.lit(root), "folder").alias("source_path"), notes.alias("notes"),
    )


def event_windows(pairs: DataFrame) -> DataFrame:
    """(clip_id, has_fall, start_frame, end_frame, error) of pairs (path, event): the clip is the video's stem; without a fall both bounds are null."""
    return pairs.select(
        stem(F.col("path")).alias("clip_id"), F.coalesce(F.col("event.start").isNotNull(), F.lit(False)).alias("has_fall"),
        F.col("event.start").alias("start_frame"), F.col("event.end").alias("end_frame"), F.col("event.error").alias("error"),
    )


def pair_annotations(videos: DataFrame, annotations: DataFrame, root: str, fallback_fps: float | None = None, frame_size: tuple[int, int] | None = None) -> DataFrame:
    """Videos (path, fps) with the annotation (path, text) at root/stem.txt or else root/stem/stem.txt, its event and its boxes.

    A video without one has null there; fps comes from the file or the fallback, else a reason.
    """
    v = videos.where(F.lower(F.substring_index("path", ".", -1)).isin(*fixed.VIDEO_EXTENSIONS)).withColumn("stem", stem(F.col("path")))
    a = annotations.withColumn("stem", stem(F.col("path")))
    place = lambda *parts: F.concat(F.lit(root.rstrip("/")), *(x for p in parts for x in (F.lit("/"), p)), F.lit(".txt"))
    rank = F.when(F.col("path") == place(F.col("stem")), 1).when(F.col("path") == place(F.col("stem"), F.col("stem")), 2)
    a = a.withColumn("rank", rank).where("rank is not null").groupBy("stem").agg(F.min_by(F.struct("path", "text"), "rank").alias("a"))
    event, boxes = parse_annotation(F.col("a.text"), frame_size)
    fps = F.coalesce("fps", F.lit(fallback_fps).cast("double"))
    found = F.col("a").isNotNull()
    return v.join(a, "stem", "left").select(
        "path", F.col("a.path").alias("annotation"), F.when(found, event).alias("event"), F.when(found, boxes).alias("detections"), fps.alias("fps"),
        F.when(fps.isNull(), fixed.NO_FPS).alias("fps_reason"),
    )


def staged(expected: DataFrame, found: DataFrame) -> bool:
    """Whether every expected file is there: a copy that lacks one is not staged."""
    return missing_files(expected, found).isEmpty()


def missing_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of expected (path) that no file of found (path) is."""
    return expected.join(found.select("path"), "path", "left_anti")


def expected_archives(spark: SparkSession, base: str) -> DataFrame:
    """(url, folder): the 30 fall and 40 daily-life archives of the public data set's first camera."""
    rows = spark.range(1, 31).select(F.format_string("fall-%02d-cam0-rgb", "id").alias("folder")).unionAll(spark.range(1, 41).select(F.format_string("adl-%02d-cam0-rgb", "id")))
    return rows.select(F.concat(F.lit(base.rstrip("/") + "/"), "folder", F.lit(".zip")).alias("url"), "folder")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Tracked detections; rows without a track are left out."""
    return spark.read.schema(DETECTION).json(path).where("track_id is not null")



"""Frame-label series and labels of windows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelore.functions import fixed


def series_stats(frames: DataFrame) -> DataFrame:
    """Per sequence: frame count, range, and whether its frames are exactly 1..n."""
    n, distinct = F.count("*"), F.count_distinct("frame_number")
    return frames.groupBy("sequence").agg(
        n.alias("frame_count"), F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"),
        ((F.min("frame_number") == 1) & (F.max("frame_number") == n) & (distinct == n)).alias("contiguous"),
    )


def lookup_stats(wanted: DataFrame, frames: DataFrame) -> DataFrame:
    """Counts and ranges of the wanted sequences, 0 for unknown ones."""
    stats = series_stats(frames)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return wanted.join(stats, "sequence", "left").select("sequence", zero("frame_count"), zero("first_frame"), zero("last_frame"))


def lookup(wanted: DataFrame, frames: DataFrame) -> DataFrame:
    """wanted (sequence, frame_number) with the frame's label, null where there is none."""
    return wanted.join(frames.select("sequence", "frame_number", "label"), ["sequence", "frame_number"], "left")


def rejects(raw: DataFrame) -> DataFrame:
    """Rows of split label lines (line_number, fields array) with the first error of each bad one, duplicates included."""
    seq, num, label = F.trim(F.get("fields", F.lit(0))), F.trim(F.get("fields", F.lit(1))), F.trim(F.get("fields", F.lit(2)))
    frame, value = num.try_cast("int"), label.try_cast("int")
    error = (
        F.when(F.size("fields") < 3, "columns").when(F.coalesce(seq, F.lit("")) == "", "sequence").when(frame.isNull() | value.isNull(), "not an integer")
        .when(frame < 1, "frame").when(~value.isin(*fixed.FRAME_LABELS), "label")
    )
    rows = raw.select("*", seq.alias("sequence"), frame.alias("frame_number"), value.alias("label"), error.alias("error"))
    twice = rows.where("error is null").groupBy("sequence", "frame_number").agg(F.count("*").alias("n"), F.max("line_number").alias("line_number")).where("n > 1")
    found = rows.where("error is not null").select("line_number", "error")
    return found.unionAll(twice.select("line_number", F.lit("duplicate").alias("error")))


#: A rule makes (label, is_confuser) of the clip type and aggregates over the labels of a window's frames.
Rule = Callable[[Column, Column], tuple[Column, Column]]


def default_rule(clip_type: Column, label: Column) -> tuple[Column, Column]:
    """Fall clips: fall if any frame is 0 or 1, unlabeled without labels; daily life: no_fall, a confuser if any is 1."""
    hit, any_label = F.coalesce(F.bool_or(label.isin(0, 1)), F.lit(False)), F.count(label) > 0
    kind = F.first(clip_type)
    text = F.when(kind == "fall", F.when(hit, "fall").when(~any_label, "unlabeled").otherwise("no_fall")).otherwise("no_fall")
    return text, (kind != "fall") & F.coalesce(F.bool_or(label == 1), F.lit(False))


def falling_only_rule(clip_type: Column, label: Column) -> tuple[Column, Column]:
    """A stricter rule: fall only where a frame is lying (1)."""
    hit = F.coalesce(F.bool_or(label == 1), F.lit(False))
    kind = F.first(clip_type)
    return F.when(kind == "fall", F.when(hit, "fall").when(F.count(label) == 0, "unlabeled").otherwise("no_fall")).otherwise("no_fall"), (kind != "fall") & hit


#: A rule in Python: from the clip type and the labels of a window's frames (NaN where a frame has none) to (label, is_confuser).
PythonRule = Callable[[str, np.ndarray], tuple[str, bool]]


def _checked(found: object) -> tuple[str, bool]:
    if not (isinstance(found, tuple) and len(found) == 2 and found[0] in fixed.WINDOW_LABELS and isinstance(found[1], (bool, np.bool_))):
        raise ValueError(f"a rule gives one of {fixed.WINDOW_LABELS} and whether it is a confuser, not {found!r}")
    return found[0], bool(found[1])


RULE_RESULT = "struct<label:string,is_confuser:boolean>"


def _function(rule: PythonRule):
    """A rule as a function of the clip type and the list of a window's labels: batches of windows go to it in Arrow."""

    @F.arrow_udf(RULE_RESULT)
    def apply(clip_type: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for kind, values in zip(clip_type, found):
            label = values.values.to_numpy(zero_copy_only=False).astype(float) if values.is_valid else np.zeros(0)
            out.append(dict(zip(("label", "is_confuser"), _checked(rule(kind.as_py(), label)))))
        return pa.array(out, pa.struct([("label", pa.string()), ("is_confuser", pa.bool_())]))

    return apply


def python_rule(rule: PythonRule) -> Rule:
    """A rule in Python for label_windows(): the labels of a window, which are few, are gathered, then the rule sees windows batch by batch."""
    apply = _function(rule)

    def columns(clip_type: Column, label: Column) -> tuple[Column, Column]:
        result = apply(F.first(clip_type), F.collect_list(F.coalesce(label.cast("double"), F.lit(float("nan")))))
        return result["label"], result["is_confuser"]

    return columns


def register_rule(spark: SparkSession, name: str, rule: PythonRule) -> None:
    """Make a rule usable in SQL text: name(clip type, labels) is a struct of label and is_confuser.

    labels is an array of doubles, as collect_list(coalesce(label, double('NaN'))) makes it of a group.  A result outside the rule's domain raises.
    """
    if not name.isidentifier():
        raise ValueError(f"not a function name: {name!r}")
    spark.udf.register(name, _function(rule))


#: Rows of frame labels for each task where windows meet them.
ROWS_PER_TASK = 500_000


def partitions_for(frames: DataFrame) -> int:
    """How many partitions hold about ``ROWS_PER_TASK`` rows each, at least one for each core; counts the rows."""
    return max(frames.sparkSession.sparkContext.defaultParallelism, -(-frames.count() // ROWS_PER_TASK))


def frame_labels(frames: DataFrame, partitions: int) -> DataFrame:
    """(sequence, frame_number, label) with the largest label of each frame, dealt over so many partitions by frame."""
    rows = frames.select("sequence", "frame_number", "label").repartition(partitions, "sequence", "frame_number")
    return rows.groupBy("sequence", "frame_number").agg(F.max("label").alias("label"))


def label_windows(windows: DataFrame, frames: DataFrame, offset: int = 0, rule: Rule = default_rule, partitions: int | None = None) -> DataFrame:
    """(sequence, window_index, label, is_confuser) of windows (sequence, clip_type, window_index, frame_indices).

    A left join of the windows' frames, moved by offset, with the labels: frames without a label count as none.
    ``partitions`` (from partitions_for()) bounds what a task holds whatever the input; without it the session decides.
    """
    dealt = lambda df, *by: df if partitions is None else df.repartition(partitions, *by)
    at = windows.select("sequence", "clip_type", "window_index", F.explode_outer("frame_indices").alias("f"))
    at = dealt(at.select("sequence", "clip_type", "window_index", (F.col("f") + offset).alias("frame_number")), "sequence", "frame_number")
    text, confuser = rule(F.col("clip_type"), F.col("label"))
    found = at.join(frames.select("sequence", "frame_number", "label"), ["sequence", "frame_number"], "left")
    found = dealt(found.select("sequence", "window_index", "clip_type", "label"), "sequence", "window_index")
    return found.groupBy("sequence", "window_index").agg(text.alias("label"), confuser.alias("is_confuser"))

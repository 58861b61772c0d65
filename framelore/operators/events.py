"""Persistence alerts over score streams, their matching with ground-truth intervals, event metrics."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framelore.functions import fixed
from framelore.functions.na import metric


#: Frames that make up a block of a score stream, and a bucket in which alerts meet windows.
BLOCK, BUCKET = 1 << 16, 1 << 10


def alerts(scores: DataFrame, threshold: float = 0.80, persistence: int = 10, block: int = BLOCK) -> DataFrame:
    """(clip_id, alert): every persistence-th frame in a row with score >= threshold; NaN and null break a row.

    scores: (clip_id, pos, score) and optionally clip_start_frame; frames are counted in the order of pos, gaps don't
    matter; rows without pos are left out.  A segmented scan: blocks of positions are numbered each on its own, a block
    is summed up as its length and its last miss, and what runs on from the blocks before it comes from these sums.
    No task sorts more than a block.
    """
    keys = ["clip_id", "block"]
    hit = F.coalesce((F.col("score") >= threshold) & ~F.isnan("score"), F.lit(False))
    start = F.col("clip_start_frame") if "clip_start_frame" in scores.columns else F.lit(0)
    rows = scores.where("pos is not null").select("clip_id", F.floor(F.col("pos") / block).alias("block"), F.col("pos").cast("long").alias("pos"), hit.alias("hit"), start.cast("long").alias("start"))
    inside = W.partitionBy(keys).orderBy("pos")
    rows = rows.withColumn("n", F.row_number().over(inside).cast("long"))
    rows = rows.withColumn("miss", F.max(F.when(~F.col("hit"), F.col("n"))).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    sums = rows.groupBy(keys).agg(F.count("*").alias("length"), F.max("miss").alias("last"))
    before = W.partitionBy("clip_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("past", F.coalesce(F.sum("length").over(before), F.lit(0)))
    carried = F.col("past") - F.coalesce(F.max(F.col("past") + F.col("last")).over(before), F.lit(0))
    sums = sums.select(F.col("clip_id").alias("__c"), F.col("block").alias("__b"), carried.alias("carried"))
    rows = rows.join(sums, F.col("clip_id").eqNullSafe(F.col("__c")) & (F.col("block") == F.col("__b")))
    run = F.when(F.col("miss").isNull(), F.col("n") + F.col("carried")).otherwise(F.col("n") - F.col("miss"))
    return rows.where(F.col("hit") & (run % persistence == 0)).select("clip_id", (F.col("pos") + F.col("start")).alias("alert"))


def _windows(events: DataFrame, tolerance: int) -> DataFrame:
    """(clip_id, ord, start_frame, lo, hi, piece): tolerated windows; those that overlap, directly or through others, are a piece.

    Windows without a bound hold nothing; they come first.
    """
    least = F.lit(-(2**63))
    number = lambda c: F.col(c).cast("long")
    e = events.where("clip_id is not null").select(
        "clip_id", number("ord").alias("ord"), number("start_frame").alias("start_frame"),
        F.coalesce(number("start_frame") - tolerance, least).alias("lo"), F.when(F.col("start_frame").isNotNull(), number("end_frame") + tolerance).alias("hi"),
    ).withColumn("hi", F.coalesce("hi", least))
    order = W.partitionBy("clip_id").orderBy("lo", "hi", "ord")
    fresh = F.col("lo") > F.coalesce(F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)), least)
    e = e.withColumn("fresh", fresh.cast("long"))
    return e.withColumn("piece", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("fresh")


def _placed(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct alerts (clip_id, alert) with the piece that holds them, null where none does.

    Pieces don't overlap; alerts meet them in buckets of frames, not by comparing a clip's alerts with all its windows.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    p = windows.where("lo <= hi").groupBy("clip_id", "piece").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    p = p.withColumn("bucket", F.explode(F.sequence(bucket("lo"), bucket("hi"))))
    a = found.select("clip_id", F.col("alert").cast("long").alias("alert")).where("clip_id is not null and alert is not null").distinct().withColumn("bucket", bucket("alert"))
    on = (a["clip_id"] == p["clip_id"]) & (a["bucket"] == p["bucket"]) & a["alert"].between(p["lo"], p["hi"])
    return a.join(p, on, "left").select(a["clip_id"], a["alert"], p["piece"])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (clip_id, piece, at, ord, start_frame, hi) sorted by piece and place, windows (ord not null) before alerts, to outcomes; a piece below zero is no window's.

    Open windows lie in a heap by ord; one whose end has gone by can't match any more.  What is held is the open windows.
    """
    names, piece, heap = ("clip_id", "alert", "ord", "start_frame", "outcome"), None, []
    kind = None
    for batch in batches:
        out = []
        kind = kind or batch.schema.field("clip_id").type
        for clip, number, at, order, start, hi in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if number < 0:
                out.append((clip, at, None, None, "false_alarm"))
                continue
            if (clip, number) != piece:
                out += [(piece[0], None, o, s, "missed") for o, _, s in heap]
                piece, heap = (clip, number), []
            if order is not None:
                heapq.heappush(heap, (order, hi, start))
                continue
            while heap and heap[0][1] < at:
                o, _, s = heapq.heappop(heap)
                out.append((clip, None, o, s, "missed"))
            if heap:
                o, _, s = heapq.heappop(heap)
                out.append((clip, at, o, s, "matched"))
            else:
                out.append((clip, at, None, None, "redundant"))
        if out:
            yield _outcomes(out, names, kind)
    if heap:
        yield _outcomes([(piece[0], None, o, s, "missed") for o, _, s in heap], names, kind)


def _outcomes(rows: list[tuple], names: tuple[str, ...], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def matching(found: DataFrame, events: DataFrame, tolerance: int = 0) -> DataFrame:
    """(clip_id, alert, ord, start_frame, outcome): a row for each distinct alert, and one for each event that none matched.

    Alerts ascending, each takes the first event by ord, not yet taken, whose window [start - tolerance, end + tolerance]
    holds it: matched.  Others in a window are redundant, the rest false_alarm; events left over are missed.  Overlapping windows make up
    pieces, which are independent; a piece is swept once in the order of frames.  Rows with null clip_id are left out; ord must not be null.
    """
    w = _windows(events, tolerance)
    a = _placed(found, w)
    none = F.lit(None).cast("long")
    # alerts outside all windows go through the sweep too, so that alerts are read once; by buckets below zero they spread
    piece = F.coalesce("piece", -1 - F.abs(F.floor(F.col("alert") / BUCKET)))
    both = w.select("clip_id", "piece", F.col("lo").alias("at"), "ord", "start_frame", "hi").unionAll(a.select("clip_id", piece, F.col("alert"), none, none, none))
    both = both.repartition("clip_id", "piece").sortWithinPartitions("clip_id", "piece", "at", F.col("ord").asc_nulls_last())
    kind = dict(both.dtypes)["clip_id"]
    return both.mapInArrow(_sweep, f"clip_id {kind}, alert long, ord long, start_frame long, outcome string")


def match(found: DataFrame, events: DataFrame, tolerance: int = 0) -> DataFrame:
    """(clip_id, ord, start_frame, alert, delay) of the matched pairs of matching()."""
    m = matching(found, events, tolerance).where(F.col("outcome") == "matched")
    return m.select("clip_id", "ord", "start_frame", "alert", (F.col("alert") - F.col("start_frame")).alias("delay"))


def false_alarms(found: DataFrame, events: DataFrame, tolerance: int = 0) -> DataFrame:
    """Alerts that no tolerated window holds."""
    return _placed(found, _windows(events, tolerance)).where("piece is null").select("clip_id", "alert")


def clip_counts(clips: DataFrame, found: DataFrame, events: DataFrame, tolerance: int = 0) -> DataFrame:
    """One row per clip of clips (clip_id, dataset, fps, total_frames): supports, false alarms, delays; one pass over matching()."""
    m = matching(found, events, tolerance).select("clip_id", "outcome", "alert", "ord", (F.col("alert") - F.col("start_frame")).alias("delay"))
    # equal delays are one row with a count, so that a clip's delays make a short list whatever the number of its events
    m = m.groupBy("clip_id", "delay").agg(
        F.count("ord").alias("events"), F.count("alert").alias("alerts"), F.count_if(F.col("outcome") == "matched").alias("matched"), F.count_if(F.col("outcome") == "false_alarm").alias("false")
    )
    counts = m.groupBy("clip_id").agg(
        F.sum("events").alias("total_events"), F.sum("alerts").alias("total_alerts"), F.sum("matched").alias("matched_events"), F.sum("false").alias("false_alarms"),
        F.try_divide(F.sum(F.col("delay") * F.col("matched")), F.sum(F.when(F.col("delay").isNotNull(), F.col("matched")))).alias("delay_mean"),
        F.percentile("delay", F.lit(0.95), F.coalesce("matched", F.lit(0))).alias("delay_p95"),
    )
    out = clips.join(counts, "clip_id", "left")
    names = ("total_events", "total_alerts", "matched_events", "false_alarms")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in names})


def ratios(counts: DataFrame) -> DataFrame:
    """Recall, precision (of matched events and false alarms) and F1, null where undefined."""
    recall, precision = F.try_divide("matched_events", "total_events"), F.try_divide("matched_events", F.col("matched_events") + F.col("false_alarms"))
    f1 = F.try_divide(2.0 * precision * recall, precision + recall)
    hours = F.when((F.col("fps") > 0) & (F.col("total_frames") > 0), F.col("total_frames") / F.col("fps") / 3600.0) if "fps" in counts.columns else None
    out = counts.withColumns({"event_recall": recall, "event_precision": precision, "event_f1": f1})
    return out if hours is None else out.withColumn("false_alarms_per_hour", F.try_divide("false_alarms", hours))


def metric_rows(counts: DataFrame) -> DataFrame:
    """Thirteen rows per clip (clip_id, dataset, name, value, na_reason, higher_is_better)."""
    c = ratios(counts)
    no_fps, no_match = F.coalesce(F.col("fps") <= 0, F.lit(True)), F.col("delay_mean").isNull()
    undefined = F.col("event_recall").isNull() | F.col("event_precision").isNull()
    delays = [(no_match, fixed.NO_EVENTS)]
    seconds = [(no_fps, fixed.NO_FPS), (no_match, fixed.NO_EVENTS)]
    rows = [
        metric("event_recall", F.col("event_recall"), [(F.col("total_events") == 0, fixed.NO_EVENTS)]),
        metric("event_precision", F.col("event_precision"), [(F.col("event_precision").isNull(), fixed.NO_ALERTS)]),
        metric("event_f1", F.col("event_f1"), [(undefined, fixed.UNDEFINED), (F.col("event_f1").isNull(), fixed.BOTH_ZERO)]),
        metric("false_alarms", F.col("false_alarms"), higher_is_better=False),
        metric("false_alarms_per_hour", F.col("false_alarms_per_hour"), [(F.col("false_alarms_per_hour").isNull(), fixed.NO_FPS)], False),
        metric("detection_delay_mean_frames", F.col("delay_mean"), delays, False),
        metric("detection_delay_p95_frames", F.col("delay_p95"), delays, False),
        metric("detection_delay_mean_seconds", F.try_divide("delay_mean", "fps"), seconds, False),
        metric("detection_delay_p95_seconds", F.try_divide("delay_p95", "fps"), seconds, False),
        metric("total_events", F.col("total_events")), metric("matched_events", F.col("matched_events")),
        metric("matched_alerts", F.col("matched_events")), metric("total_alerts", F.col("total_alerts")),
    ]
    return c.select("clip_id", "dataset", F.inline(F.array(*rows)))


def pooled(counts: DataFrame) -> DataFrame:
    """Per dataset: supports summed over its clips, then recall, precision and F1 of the sums."""
    sums = counts.groupBy("dataset").agg(*(F.sum(c).alias(c) for c in ("total_events", "total_alerts", "matched_events", "false_alarms")))
    return ratios(sums)


def pooled_rows(counts: DataFrame) -> DataFrame:
    """Seven rows (dataset, name, value, na_reason, higher_is_better) per dataset; alerts are those that count: matched ones and false alarms."""
    c = pooled(counts)
    alerts_ = F.col("matched_events") + F.col("false_alarms")
    rows = [
        metric("event_recall", F.col("event_recall"), [(F.col("event_recall").isNull(), fixed.NO_EVENTS)]),
        metric("event_precision", F.col("event_precision"), [(F.col("event_precision").isNull(), fixed.NO_ALERTS)]),
        metric("event_f1", F.col("event_f1"), [(F.col("event_f1").isNull(), fixed.UNDEFINED)]),
        metric("total_events", F.col("total_events")), metric("matched_events", F.col("matched_events")),
        metric("matched_alerts", F.col("matched_events")), metric("total_alerts", alerts_),
    ]
    return c.select("dataset", F.inline(F.array(*rows)))


def component_rows(slices: DataFrame, detection: bool = False, tracking: bool = False, pose: bool = False) -> DataFrame:
    """Six rows (name, value, na_reason) per row of slices for component metrics that aren't integrated: never a value, the reason
    depends on the ground truth given."""
    why = fixed.COMPONENT_REASONS
    given = {"map_50": (detection, "detection"), "map_50_95": (detection, "detection")} | {n: (tracking, "tracking") for n in ("idf1", "mota", "hota")} | {"pck": (pose, "pose")}
    row = lambda n, has, kind: F.struct(F.lit(n).alias("name"), F.lit(None).cast("double").alias("value"), F.lit(why["pending" if has else kind]).alias("na_reason"))
    return slices.select("*", F.inline(F.array(*(row(n, *g) for n, g in given.items()))))

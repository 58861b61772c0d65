"""Persistence alerts over a stream of scores in event time, their meeting with a stream of events, counts by day."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALERT = "clip_id long, alert long"


class Persistence(StatefulProcessor):
    """State of a clip: next position, length of the run, frames waiting, latest time; frames that came early, by position.

    Frames count as soon as all before them have come.  A clip whose latest frame lies ``timeout`` before the watermark is
    over: what still waits counts in the order of positions, whatever is missing between, and its state goes.
    """

    def __init__(self, threshold: float, persistence: int, first: int, timeout: int) -> None:
        self.threshold, self.persistence, self.first, self.timeout = threshold, persistence, first, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "next long, run long, waiting long, latest long")
        self.early = handle.getMapState("early", "pos long", "hit boolean, start long")

    def _count(self, key: tuple, run: int, pos: np.ndarray, hit: np.ndarray, start: np.ndarray) -> tuple[int, pd.DataFrame]:
        """The run's length after these frames, and the alerts in them."""
        n = np.arange(1, len(hit) + 1)
        broken = np.maximum.accumulate(np.where(hit, 0, n)) if len(hit) else n
        length = n - broken + np.where(broken == 0, run, 0)
        found = (pos + start)[hit & (length % self.persistence == 0)]
        return int(length[-1]) if len(hit) else run, pd.DataFrame({"clip_id": np.full(len(found), key[0]), "alert": found}).astype("int64")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, run, waiting, latest = self.progress.get() if self.progress.exists() else (self.first, 0, 0, -1)
        before, ready = latest, []
        for pdf in rows:
            pdf = pdf.sort_values("pos")
            latest = max(latest, int(pdf["ts"].astype("int64").max() // 1_000_000 if pdf["ts"].dtype.kind == "i" else pdf["ts"].max().timestamp() * 1000))
            hits = (pdf["score"].astype("float64") >= self.threshold).to_numpy()
            for pos, hit, start in zip(pdf["pos"].tolist(), hits.tolist(), pdf["clip_start_frame"].tolist()):
                if pos == at:
                    ready.append((pos, hit, start))
                    at += 1
                elif pos > at and not (waiting and self.early.containsKey((pos,))):  # a frame that comes twice counts once
                    self.early.updateValue((pos,), (hit, start))
                    waiting += 1
                while waiting and self.early.containsKey((at,)):
                    ready.append((at, *self.early.getValue((at,))))
                    self.early.removeKey((at,))
                    at, waiting = at + 1, waiting - 1
        pos, hit, start = (np.array(c) for c in zip(*ready)) if ready else (np.zeros(0, int), np.zeros(0, bool), np.zeros(0, int))
        run, found = self._count(key, run, pos, hit.astype(bool), start)
        self.progress.update((at, run, waiting, latest))
        if latest > before:
            if before >= 0:
                self.handle.deleteTimer(before + self.timeout)
            self.handle.registerTimer(latest + self.timeout)
        yield found

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, run, _, _ = self.progress.get()
        rest = sorted((int(k[0]), bool(v[0]), int(v[1])) for k, v in self.early.iterator())
        pos, hit, start = (np.array(c) for c in zip(*rest)) if rest else (np.zeros(0, int), np.zeros(0, bool), np.zeros(0, int))
        found = self._count(key, run, pos, hit.astype(bool), start)[1]
        self.early.clear()
        self.progress.clear()
        yield found

    def close(self) -> None:
        pass


def streaming_alerts(scores: DataFrame, threshold: float = 0.80, persistence: int = 10, first: int = 0, timeout: str = "1 hour") -> DataFrame:
    """(clip_id, alert) from a streaming DataFrame (clip_id long, pos long, score double, ts timestamp[, clip_start_frame long]).

    ts needs a watermark.  Positions count up from ``first``; they may come in any order and batch, and the rows are those
    of the batch operator alerts() over the finished clip: frames wait for those before them, at most until the clip is over, which it is when
    the watermark is ``timeout`` past its latest frame; then its state goes.  Frames that come twice count once; null and
    NaN scores break a run.  Needs the RocksDB state store (session.PROVIDER; session() sets it).
    """
    spark = scores.sparkSession
    milliseconds = int(spark.range(1).select(F.unix_millis(F.timestamp_millis(F.lit(0)) + F.expr(f"interval {timeout}"))).first()[0])
    start = F.coalesce(F.col("clip_start_frame"), F.lit(0)) if "clip_start_frame" in scores.columns else F.lit(0)
    rows = scores.where("pos is not null").select("clip_id", "pos", F.coalesce("score", F.lit(float("nan"))).alias("score"), "ts", start.cast("long").alias("clip_start_frame"))
    return rows.groupBy("clip_id").transformWithStateInPandas(Persistence(threshold, persistence, first, milliseconds), ALERT, "Append", "EventTime")


def streaming_matches(found: DataFrame, events: DataFrame, tolerance: str = "0 seconds", longest: str = "1 hour") -> DataFrame:
    """(clip_id, ord, start_ts, alert_ts): alerts (clip_id, alert_ts) in the tolerated windows of events (clip_id, ord, start_ts, end_ts).

    An interval join of two streams with watermarks on alert_ts and start_ts; ``longest`` bounds an event's length, so that both
    sides' state ends with the watermark.  A window that is longer matches up to there.
    """
    e = events.withColumnRenamed("clip_id", "__c")
    slack = F.expr(f"interval {tolerance}")
    inside = (F.col("alert_ts") >= F.col("start_ts") - slack) & (F.col("alert_ts") <= F.col("start_ts") + F.expr(f"interval {longest}") + slack)
    both = found.join(e, (F.col("clip_id") == F.col("__c")) & inside & (F.col("alert_ts") <= F.col("end_ts") + slack))
    return both.select("clip_id", "ord", "start_ts", "alert_ts")


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per day and type, late ones up to the watermark; ts may be without a time zone."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

"""Streaming forms of what is incremental by nature: linking, chunk statistics, event sessions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from framesift.functions.boxes import CORNERS
from framesift.operators.tracking import LiveTracks, Linking, link_frame

#: Boxes that wait for their frame to be over, packed as records of ``BOX``; the last box of each live track; the time of a key's timer.
WAITING, LIVE, WAKE = "boxes binary", "tid array<long>, box array<double>, last array<long>", "time long"
BOX = np.dtype([("frame", np.int64), ("id", np.int64), ("over", np.int64), ("score", np.float64), ("box", np.float64, 4)])
#: Linked rows given out at once, about.
ROWS_OUT = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ordered_state(spark: SparkSession) -> None:
    """Linking keeps its state by frame, for which the session's streams need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FrameLinker(StatefulProcessor):
    """Holds every frame of a key back until the watermark passes its end, then links it.

    Frames are linked in their order and whole, whatever order their boxes came in.  A key has one timer at a time, for the
    first frame that waits or else for the end of its tracks, so what waits is looked through once a micro-batch.
    """

    def __init__(self, rules: Linking, key: str, by: Sequence[str], idle_ms: int):
        self.rules, self.key, self.by, self.idle_ms = rules, key, list(by), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.live = handle.getValueState("live", LIVE)
        self.wake = handle.getValueState("wake", WAKE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if any(k is None for k in key):  # a closing row has no key
            return
        first = None
        for part in rows:
            part = part[part["frame_id"].notna()]
            if not len(part):
                continue
            came = np.empty(len(part), BOX)
            came["frame"], came["id"], came["over"] = (part[c].fillna(0).to_numpy(np.int64) if c == "over_ms" else part[c].to_numpy(np.int64) for c in ("frame_id", self.key, "over_ms"))
            came["score"], came["box"] = part["confidence"].to_numpy(float), part[list(CORNERS)].to_numpy(float)
            self.waiting.appendValue((came.tobytes(),))
            first = int(came["over"].min()) if first is None else min(first, int(came["over"].min()))
        if first is not None:
            held = self.wake.get()
            if held is None or first < held[0]:
                if held is not None:
                    self.handle.deleteTimer(held[0])
                self._wake_at(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        boxes = np.concatenate([np.zeros(0, BOX), *(np.frombuffer(x[0], BOX) for x in self.waiting.get())])
        boxes = boxes[np.lexsort([boxes["id"], boxes["frame"]])]
        starts = np.flatnonzero(np.r_[True, boxes["frame"][1:] != boxes["frame"][:-1]]) if len(boxes) else np.zeros(0, int)
        over = np.maximum.reduceat(boxes["over"], starts) if len(starts) else boxes["over"]
        later = over[over > now]
        self.wake.clear()
        if len(later) < len(over):
            live = LiveTracks()
            if self.live.exists():
                tid, box, last = self.live.get()
                live = LiveTracks(np.array(tid, np.int64), np.array(box, float).reshape(-1, 4), np.array(last, np.int64))
            out, rows, keys = [], 0, dict(zip(self.by, key))
            for lo, hi, end in zip(starts, [*starts[1:], len(boxes)], over):
                if end > now:
                    continue
                one = boxes[lo:hi]
                out.append((one["id"], *link_frame(live, self.rules, int(one["frame"][0]), one["id"], one["box"], one["score"])))
                rows += len(one)
                if rows >= ROWS_OUT:
                    yield self._linked(keys, out)
                    out, rows = [], 0
            if out:
                yield self._linked(keys, out)
            self.live.update((live.tid.tolist(), live.box.ravel().tolist(), live.last.tolist()))
            if len(later):
                self.waiting.put([(boxes[np.repeat(over > now, np.diff(np.r_[starts, len(boxes)]))].tobytes(),)])
            else:
                self.waiting.clear()
            self._wake_at(int(later.min()) if len(later) else max(int(over.max()), now) + self.idle_ms)
        elif len(later):
            self._wake_at(int(later.min()))
        else:
            # Its last frame is a grace period old: no track of this key can go on.
            self.live.clear()

    def _wake_at(self, time: int) -> None:
        self.handle.registerTimer(time)
        self.wake.update((time,))

    def _linked(self, keys: dict, out: list) -> pd.DataFrame:
        ids, tids, off = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({**keys, self.key: ids, "tid": tids, "suppressed": off})

    def close(self) -> None:
        pass


def link_stream(boxes: DataFrame, rules: Linking, over: Column, key: str = "event_id", by: Sequence[str] = ("stream", "category"),
                delay: str = "10 minutes", frame_seconds: float = 1.0) -> DataFrame:
    """Online linking of a box stream: (by…, key, tid, suppressed), the rows that ``link_tracks`` gives.

    ``over`` is the time at which a box's frame ends.  A frame is linked once the watermark, ``delay`` behind the
    latest such time, has passed it: until then boxes may come in any order and over any number of
    micro-batches, and only boxes of frames already linked come too late and are dropped.  State per key is
    the frames that wait and the last box of each live track, which goes when no track can go on.
    The session needs ``ordered_state``; a finished stream gives out its last frames after a
    ``closing_row``.
    """
    kinds = [T.StructField(c, boxes.schema[c].dataType) for c in by]
    out = T.StructType([*kinds, T.StructField(key, T.LongType()), T.StructField("tid", T.LongType()), T.StructField("suppressed", T.BooleanType())])
    rows = boxes.select(*by, over.alias("over"), "frame_id", key, *CORNERS, "confidence").withWatermark("over", delay).withColumn("over_ms", F.unix_millis("over"))
    processor = FrameLinker(rules, key, by, int((rules.grace + 1) * frame_seconds * 1000))
    return rows.groupBy(*by).transformWithStateInPandas(processor, out, "append", "EventTime")


def closing_row(rows: DataFrame, ts: str = "ts", after: str = "100 years") -> DataFrame:
    """One row of nulls but for a time far behind all of ``rows``: as a stream's last row it moves the watermark past all that is open."""
    last = rows.agg((F.max(ts) + F.expr(f"interval {after}")).alias(ts))
    return last.select(*[F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def count_stream(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sightings per (chunk, track) of a feedback stream; run in update mode."""
    return log.groupBy(*by, "chunk_id", "track_id").agg(F.count(F.lit(1)).alias("n"))


def write_counts(batch: DataFrame, epoch: int, path: str) -> None:
    """``foreachBatch`` sink: changed counts of one batch, in a folder of its own so that a retry overwrites it."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")


def current_chunk_stats(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Chunk statistics from the newest count of every (chunk, track): hits, seen once, distinct."""
    keys = [*by, "chunk_id"]
    changes = spark.read.parquet(path)
    newest = changes.groupBy(*keys, "track_id").agg(F.max_by("n", "batch").alias("n"))
    seen = newest.where(F.col("track_id").isNotNull())
    return seen.groupBy(*keys).agg(F.sum("n").alias("n_hits"), F.count_if(F.col("n") == 1).alias("n_once"), F.count(F.lit(1)).alias("n_unique"))


def event_sessions(positives: DataFrame, gap: str, delay: str | None = None, by: Sequence[str] = ("category",)) -> DataFrame:
    """Positives closer than a gap form one event (session rule); works on streams and tables alike.

    Partial sessions merge on the map side, so a busy key is folded before it is shuffled.
    """
    rows = positives if delay is None else positives.withWatermark("ts", delay)
    s = rows.groupBy(*by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

"""Operators on ordered score series: smoothing, runs, clip timelines, as-of lookup.

Long axes are cut into blocks; a block sees the border rows it needs and only its own rows leave.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.ordinal import SampledBucket, block_of, running, sampled_bucket, with_bucket


def smooth_scores(scores: DataFrame, window: int, col: str = "score", by: Sequence[str] = ("category",),
                  block: int = 8192) -> DataFrame:
    """Centred Gaussian mean over an odd window of consecutive frames, deviation window//2.

    Nulls count as 0; weights are renormalised at the ends; windows of 1 pass through.
    """
    if window % 2 != 1:
        raise ValueError("the window must be odd")
    filled = scores.withColumn(col, F.coalesce(F.col(col), F.lit(0.0)))
    if window <= 2:
        return filled.withColumn("smooth", F.col(col))
    h = window // 2
    first, last = F.floor((F.col("frame_id") - h) / block), F.floor((F.col("frame_id") + h) / block)
    spread = filled.withColumn("__block", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*by, "__block").orderBy("frame_id").rangeBetween(-h, h)
    near = spread.withColumn("__near", F.collect_list(F.struct("frame_id", F.col(col).alias("v"))).over(w))
    own = near.where(F.floor(F.col("frame_id") / block) == F.col("__block"))
    weight = lambda s: F.exp(-0.5 * F.pow((s["frame_id"] - F.col("frame_id")) / h, F.lit(2.0)))
    total = lambda term: F.aggregate(F.transform("__near", term), F.lit(0.0), lambda a, x: a + x)
    mean = total(lambda s: weight(s) * s["v"]) / total(weight)
    return own.withColumn("smooth", F.when(F.size("__near") >= h, mean)).drop("__near", "__block")


def label_runs(rows: DataFrame, flag: Column, by: Sequence[str] = (), axis: str = "frame_id", limit: float | None = None,
               step: float = 1, block: int = 8192, name: str = "run_start") -> DataFrame:
    """Start of the run of consecutive true rows each row belongs to, null for false rows.

    With ``limit`` a new run starts once the distance from the start exceeds it; the axis must then
    be evenly spaced by ``step``.
    """
    by = list(by)
    on = rows.withColumn("__on", F.coalesce(flag, F.lit(False))).withColumn("__block", F.floor(F.col(axis) / block))
    inside = Window.partitionBy(*by, "__block").orderBy(axis)
    begins = F.when(F.col("__on") & ~F.lag("__on").over(inside), F.col(axis))
    on = on.withColumn("__begin", begins)
    on = on.withColumn("__local", F.last("__begin", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = on.groupBy(*by, "__block").agg(
        F.min(axis).alias("__first"), F.max_by("__on", axis).alias("__ends_on"), F.max("__begin").alias("__latest"))
    across = Window.partitionBy(*by).orderBy("__block")
    ends = ends.withColumn("__goes_on", F.coalesce(F.lag("__ends_on").over(across), F.lit(False)))
    # Start of the run still open at the block's end; null when it came in from the block before.
    open_ = F.when(F.col("__latest").isNotNull(), F.col("__latest")).when(~F.col("__goes_on"), F.col("__first"))
    ends = ends.withColumn("__open", F.when(F.col("__ends_on"), open_))
    carried = F.last("__open", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("__entry", F.when(F.col("__goes_on"), carried).otherwise(F.col("__first"))).select(*by, "__block", "__entry")
    joined = on.join(ends, [*by, "__block"])
    start = F.coalesce("__local", "__entry")
    if limit is not None:
        period = int(limit // step) * step + step
        start = start + F.floor((F.col(axis) - start) / period) * period
    return joined.select(*rows.columns, F.when(F.col("__on"), start).alias(name))


def score_instances(scores: DataFrame, window: int, threshold: float, by: Sequence[str] = ("category",),
                    limit: float | None = None, block: int = 8192) -> DataFrame:
    """Instance label per frame and class: runs of smoothed scores above the threshold, null where the raw score is not."""
    smooth = smooth_scores(scores, window, by=by, block=block)
    runs = label_runs(smooth, F.col("smooth") > threshold, by=by, limit=limit, block=block, name="instance")
    return runs.withColumn("instance", F.when(F.col("score") > threshold, F.col("instance")))


def with_next(rows: DataFrame, order: Sequence[Column], value: Column, by: Sequence[str] = (), name: str = "next",
              bucket: Column | SampledBucket | None = None) -> DataFrame:
    """Value of the next row in order inside each key, without one task per key."""
    by = list(by)
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    bucket = sampled_bucket(rows, order) if bucket is None else bucket
    cut = with_bucket(rows, bucket, "__bucket").withColumn("__v", value).withColumn("__key", key)
    heads = cut.groupBy(*by, "__bucket").agg(F.min_by("__v", "__key").alias("__head"))
    heads = heads.withColumn("__after", F.lead("__head").over(Window.partitionBy(*by).orderBy("__bucket"))).drop("__head")
    inside = Window.partitionBy(*by, "__bucket").orderBy("__key")
    is_last = F.lead(F.lit(True)).over(inside).isNull()
    marked = cut.withColumn("__n", F.lead("__v").over(inside)).withColumn("__last", is_last).join(heads, [*by, "__bucket"])
    return marked.select(*rows.columns, F.when(F.col("__last"), F.col("__after")).otherwise(F.col("__n")).alias(name))


def clip_timeline(clips: DataFrame, by: Sequence[str] = (), key: str = "clip_id") -> DataFrame:
    """Seconds to the next clip, the gap after the duration, and flags for missing and overlapping clips."""
    nxt = with_next(clips, [F.col("timestamp"), F.col(key)], F.col("timestamp"), by)
    diff = F.col("next") - F.col("timestamp")
    return nxt.withColumn("time_diff", diff).drop("next").withColumns({
        "time_gap": F.col("time_diff") - F.col("duration"),
        "ratio": F.col("time_diff") / F.col("duration"),
    }).withColumns({"missing_clip": F.col("ratio") > 1.1, "negative_gap": F.col("time_gap") < 0})


def every(frames: DataFrame, start: int, skip: int) -> DataFrame:
    """Frames start, start+skip, …"""
    return frames.where((F.col("frame_id") >= start) & ((F.col("frame_id") - start) % skip == 0))


def track_samples(boxes: DataFrame, limit: int, by: Sequence[str] = ("category", "track_id")) -> DataFrame:
    """About ``limit`` evenly spaced rows per track; its last frame always stays."""
    ends = boxes.groupBy(*by).agg(F.min("frame_id").alias("__a"), F.max("frame_id").alias("__z"))
    step = F.greatest(F.floor((F.col("__z") - F.col("__a")) / limit), F.lit(1))
    rows = boxes.join(ends, list(by))
    return rows.where((F.col("frame_id") == F.col("__z")) | ((F.col("frame_id") - F.col("__a")) % step == 0)).drop("__a", "__z")


def clip_starts(clips: DataFrame, size: str, key: str) -> DataFrame:
    """First global frame of every clip when clips are laid end to end in key order."""
    order = [F.col(key)]
    laid = running(clips, order, sampled_bucket(clips, order), value=F.col(size), name="__end")
    return laid.withColumn("start", F.col("__end") - F.col(size)).withColumnRenamed("__end", "end")


def locate(frames: DataFrame, starts: DataFrame, key: str, block: int = 4096) -> DataFrame:
    """Clip that holds each global frame, and the frame's offset in it.

    Clips are copied to the axis blocks they cover, so the lookup is an equi-join on the block.
    """
    cover = starts.where(F.col("end") > F.col("start")).withColumn(
        "__b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    asked = frames.withColumn("__b", block_of(F.col("frame_id"), at_least=block))
    hit = asked.join(cover.select(key, "start", "end", "__b"), "__b").where((F.col("frame_id") >= F.col("start")) & (F.col("frame_id") < F.col("end")))
    return hit.select("frame_id", key, (F.col("frame_id") - F.col("start")).alias("local_frame"))


def positional_join(parts: Sequence[DataFrame], index: str) -> DataFrame:
    """Rows of several tables side by side by index; as long as the shortest."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.join(p, index)
    return whole


def lookup(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """All rows of the asked keys."""
    return rows.join(asked.select(key).distinct(), key, "left_semi")


def in_pairs(rows: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key pair is listed."""
    return rows.join(pairs.select(*keys), list(keys), "left_semi")


# exp(-x²) is exactly 0 in a double beyond this x.
KERNEL_REACH = 27.5


def near_chunk_differences(chunks: DataFrame, time: str, sigma: float) -> DataFrame:
    """(a, b, dt): time difference of every chunk pair that a kernel of width sigma can tell from zero."""
    reach = KERNEL_REACH * sigma
    a = chunks.select(F.col("chunk_id").alias("a"), F.col(time).alias("ta"), F.floor(F.col(time) / reach).alias("__b"))
    b = chunks.select(F.col("chunk_id").alias("b"), F.col(time).alias("tb"), F.explode(F.sequence(
        F.floor(F.col(time) / reach) - 1, F.floor(F.col(time) / reach) + 1)).alias("__b"))
    return a.join(b, "__b").where(F.abs(F.col("ta") - F.col("tb")) <= reach).select("a", "b", (F.col("ta") - F.col("tb")).alias("dt"))


def smoothed_hit_rate(counters: DataFrame, time: str, sigma: float, by: Sequence[str] = ()) -> DataFrame:
    """Hit rate per chunk with neighbours mixed in by exp(−(dt/sigma)²).

    Pairs further apart than the kernel's reach weigh exactly 0 and are never formed.
    """
    by = list(by)
    near = near_chunk_differences(counters.select("chunk_id", time).distinct(), time, sigma)
    k = F.exp(-F.pow(F.col("dt") / sigma, F.lit(2.0)))
    mixed = near.join(counters.select(*by, F.col("chunk_id").alias("b"), "n_frames", "n_hit_frames"), "b")
    return mixed.groupBy(*by, F.col("a").alias("chunk_id")).agg(
        (F.sum(k * F.col("n_hit_frames")) / F.sum(k * F.col("n_frames"))).alias("rate"))

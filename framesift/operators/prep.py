"""Preparation of detection tables: track filter, exclusion, totals and multimaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.ordinal import dense_codes, in_parts, positions

MIN_TRACK_ROWS = 3


def composite(*cols: str) -> Column:
    """One text key of several columns joined by ``_``; null if any part is null."""
    return F.when(
        F.greatest(*[F.col(c).isNull().cast("int") for c in cols]) == 0 if len(cols) > 1 else F.col(cols[0]).isNotNull(),
        F.concat_ws("_", *[F.col(c).cast("string") for c in cols]),
    )


def track_totals(boxes: DataFrame) -> DataFrame:
    """Rows per (category, track)."""
    return boxes.groupBy("category", "track_id").agg(F.count("frame_id").alias("track_length"))


def valid_tracks(boxes: DataFrame, at_least: int = MIN_TRACK_ROWS) -> DataFrame:
    """Track ids with enough rows in any category; judged before exclusions."""
    return track_totals(boxes).where(F.col("track_length") >= at_least).select("track_id").distinct()


def remove_frames(df: DataFrame, excluded: DataFrame) -> DataFrame:
    return df.join(excluded.select("frame_id"), "frame_id", "left_anti")


def usable_boxes(boxes: DataFrame, excluded: DataFrame, categories: Sequence[str] | None = None,
                 at_least: int = MIN_TRACK_ROWS) -> DataFrame:
    """Boxes on allowed frames, in allowed categories, of long enough tracks."""
    ok = boxes if categories is None else boxes.where(F.col("category").isin(list(categories)))
    ok = remove_frames(ok, excluded)
    return ok.join(valid_tracks(boxes, at_least), "track_id", "left_semi")


def category_totals(ok_boxes: DataFrame, frames: DataFrame, excluded: DataFrame) -> DataFrame:
    """``total_ni`` distinct tracks per category beside ``total_nf``, the frames that may be sampled."""
    nf = remove_frames(frames, excluded).agg(F.count(F.lit(1)))
    return (
        ok_boxes.select("category", "track_id").distinct()
        .groupBy("category").agg(F.count(F.lit(1)).alias("total_ni"))
        .withColumn("total_nf", nf.scalar())
    )


def track_length_frequency(boxes: DataFrame) -> DataFrame:
    """How many tracks of each category have each length."""
    return track_totals(boxes).groupBy("category", "track_length").agg(F.count(F.lit(1)).alias("freq"))


def dense_tracks(boxes: DataFrame) -> DataFrame:
    """Code table (category, track_id, dense_id): 0-based in sorted track order per category."""
    return dense_codes(boxes, "track_id", by=["category"], name="dense_id")


LONGEST_LIST = 10000


def tracks_of_frames(hits: DataFrame, lookup: DataFrame, most: int = LONGEST_LIST) -> DataFrame:
    """Multimap lookup: every asked frame with its tracks, the empty list when it has none.

    A frame with more than ``most`` hits has several rows, told apart by ``part``.
    """
    wanted = hits.join(lookup.select("frame_id").distinct(), "frame_id", "left_semi")
    lists = in_parts(wanted, ["frame_id"], "track_id", most).groupBy("frame_id", "part").agg(
        F.array_sort(F.collect_list("track_id")).alias("tracks"))
    empty = F.array().cast(lists.schema["tracks"].dataType)
    return lookup.join(lists, "frame_id", "left").withColumn("tracks", F.coalesce("tracks", empty)).fillna(0, ["part"])


def interval_frames(intervals: DataFrame) -> DataFrame:
    """Track intervals [start, end) as one row per covered frame."""
    return intervals.where(F.col("end") > F.col("start")).select(
        *[c for c in intervals.columns if c not in ("start", "end")],
        F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("frame_id"),
    )


def arrival_codes(events: DataFrame, key: str, seen_at: str) -> DataFrame:
    """Dense 0-based codes in order of first appearance."""
    first = events.groupBy(key).agg(F.min(seen_at).alias("__first"))
    return positions(first, [F.col("__first"), F.col(key)], name="code").select(key, "code")


def frame_label_arrays(boxes: DataFrame, frames: DataFrame, labels: Sequence[str], most: int = LONGEST_LIST) -> DataFrame:
    """One row per frame, one column per label: sorted 1-based dense track codes, null when absent.

    A frame with more than ``most`` boxes has several rows, told apart by ``part``.
    """
    codes = dense_codes(boxes, "track_id", by=["category"], name="__code")
    coded = boxes.join(codes, ["category", "track_id"]).withColumn("__code", F.col("__code") + 1)
    parts = in_parts(coded.select("frame_id", "category", "__code"), ["frame_id"], "__code", most)
    wide = parts.groupBy("frame_id", "part").pivot("category", list(labels)).agg(F.array_sort(F.collect_list("__code")))
    return frames.select("frame_id").join(wide, "frame_id", "left").fillna(0, ["part"])

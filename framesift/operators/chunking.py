"""Chunk maps: cutting a frame axis, a clock or a value range into groups."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.ordinal import dense_codes, exact_quantiles, seed_key

# Seconds per unit of a duration text.
_UNITS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400}


def duration_seconds(text: str) -> float:
    m = re.fullmatch(r"\s*([\d.]+)\s*([a-z]+?)s?\s*", text.lower())
    if not m or m[2] not in _UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return float(m[1]) * _UNITS[m[2]]


def fixed_duration(frame: Column, duration: str, frame_rate: float = 30.0) -> Column:
    """Chunk number of equal durations, counted in frames."""
    return F.floor(frame / F.lit(round(duration_seconds(duration) * frame_rate))).cast("long")


def contiguous_parts(frame: Column, n: int, parts: int) -> Column:
    """Part number of ``parts`` equal ranges over ``n`` frames."""
    return F.floor(frame / F.lit(-(-n // parts))).cast("long")


def chunk_map(frames: DataFrame, selector: str, default: DataFrame | None = None, frame_rate: float = 30.0) -> DataFrame:
    """(frame_id, chunk_id) for ``nosplit``, ``default`` or a duration text."""
    if selector == "nosplit":
        return frames.select("frame_id", F.lit(0).cast("long").alias("chunk_id"))
    if selector == "default":
        if default is None:
            return frames.select("frame_id", fixed_duration(F.col("frame_id"), "30 min", frame_rate).alias("chunk_id"))
        return default.select("frame_id", "chunk_id")
    return frames.select("frame_id", fixed_duration(F.col("frame_id"), selector, frame_rate).alias("chunk_id"))


def side_table_chunks(side: DataFrame, col: str) -> DataFrame:
    """Chunks from a per-frame column: dense codes in sorted value order."""
    codes = dense_codes(side, col, name="chunk_id")
    return side.join(codes, col).select("frame_id", "chunk_id")


def box_column_chunks(boxes: DataFrame, col: str, row_order: str) -> DataFrame:
    """Chunks from a box column: the value of each frame's first row, coded in sorted value order."""
    first = boxes.groupBy("frame_id").agg(F.min_by(col, row_order).alias(col))
    return side_table_chunks(first, col)


def time_grid(epoch: Column, width: int, offset: Column | int) -> Column:
    """Start of the nearest grid point of ``width`` seconds after shifting the clock by ``offset``.

    Halves go to the even grid point.
    """
    off = F.lit(offset) if isinstance(offset, int) else offset
    return (F.rint((epoch + off) / F.lit(float(width))) * width - off).cast("long")


def value_buckets(df: DataFrame, col: str, splits: int, quantile: bool = True) -> DataFrame:
    """Label each row with the smallest cut-off that is not below its value; null stays null.

    Cut-offs are the distinct quantiles, or equal-width steps from the minimum (values above the
    last one get infinity).  They are one small array whose length is ``splits``.
    """
    if quantile:
        qs = exact_quantiles(df, col, [i / splits for i in range(splits + 1)])
        cuts = qs.agg(F.array_sort(F.collect_set("value")))
    else:
        lo, hi = F.min(col), F.max(col)
        steps = F.sequence(F.lit(0), F.lit(splits - 1))
        cuts = df.agg(F.transform(steps, lambda i: lo + i * ((hi - lo) / splits)))
    table = df.withColumn("__cuts", cuts.scalar())
    label = F.array_min(F.filter("__cuts", lambda c: c >= F.col(col)))
    return table.withColumn(
        "bucket", F.when(F.col(col).isNull(), None).otherwise(F.coalesce(label, F.lit(float("inf"))))
    ).drop("__cuts")


def prefix_chunks(names: DataFrame, col: str, sep: str = "-") -> DataFrame:
    """Chunks by the text before the first separator."""
    keyed = names.withColumn("__prefix", F.substring_index(col, sep, 1))
    codes = dense_codes(keyed, "__prefix", name="chunk_id")
    return keyed.join(codes, "__prefix").drop("__prefix")


def group_offsets(packets: DataFrame) -> DataFrame:
    """Start offset of every picture group, beside each packet."""
    starts = packets.groupBy("gop_number").agg(F.min("byte_offset").alias("gop_offset"))
    return packets.join(starts, "gop_number")


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int, seed) -> DataFrame:
    """Fold number per row so that every label is spread evenly."""
    from framesift.functions.ordinal import hex_bucket, running

    keyed = rows.withColumn("__k", seed_key(seed, key))
    ranked = running(keyed, [F.col("__k")], hex_bucket(F.col("__k"), 3), by=[label], name="__pos")
    return ranked.withColumn("fold", (F.col("__pos") % folds).cast("int")).drop("__k", "__pos")


def image_label(patches: DataFrame, image: str, labels: Sequence[str]) -> DataFrame:
    """Class of an image: the maximum over its patches of the last label column."""
    return patches.groupBy(image).agg(F.max(labels[-1]).alias("label"))

"""Dataset descriptors and reading of box tables."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions.ordinal import dense_codes


@dataclass(frozen=True)
class Dataset:
    """Where a collection's boxes are and how its columns are called."""

    name: str
    box_path: str
    track_id: str = "track_id"
    frame_id: str = "frame_id"
    category: str = "category"
    categories: tuple[str, ...] | None = None
    video_len: int | None = None
    default_chunks: str | tuple[str, str] | None = None
    split_path: str | None = None
    split_column: str | None = None


def read_data(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a table by its extension: Parquet or CSV with a header."""
    kind = PurePosixPath(path).suffix
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".csv":
        reader = spark.read.option("header", True)
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    raise ValueError(f"unknown table format: {path}")


def standardize_boxes(ds: Dataset, boxes: DataFrame) -> DataFrame:
    """Project to (track_id, frame_id, category); track ids become dense codes in sorted order, -1 if null."""
    codes = dense_codes(boxes, ds.track_id, name="__code")
    named = boxes.select(
        F.col(ds.track_id).alias("__track"), F.col(ds.frame_id).alias("frame_id"), F.col(ds.category).alias("category")
    )
    return named.join(codes.withColumnRenamed(ds.track_id, "__track"), "__track", "left").select(
        F.coalesce("__code", F.lit(-1)).cast("long").alias("track_id"), "frame_id", "category"
    )


def video_len(ds: Dataset, boxes: DataFrame) -> int:
    """Declared length, or one past the last frame with a box."""
    if ds.video_len is not None:
        return ds.video_len
    return boxes.agg(F.max(ds.frame_id)).first()[0] + 1


def categories(ds: Dataset, boxes: DataFrame) -> DataFrame:
    """The queried categories as a table."""
    if ds.categories is not None:
        return boxes.sparkSession.createDataFrame([(c,) for c in ds.categories], "category string")
    return boxes.select(F.col(ds.category).alias("category")).distinct()


def unicode_columns(df: DataFrame) -> DataFrame:
    """Plain text names for columns written with byte-string names such as ``b'frame'``."""
    plain = [c[2:-1] if len(c) > 2 and c[:2] in ("b'", 'b"') and c[-1] == c[1] else c for c in df.columns]
    return df.toDF(*plain)


def excluded_frames(splits: DataFrame) -> DataFrame:
    """Frames used to train or tune a proxy; queries must not return them."""
    return splits.where(F.col("split").isin("train", "val")).select("frame_id").distinct()

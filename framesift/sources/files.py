"""Readers and writers of the file shapes around detections."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.functions.ordinal import in_parts, positions

BOX2D = "struct<x1: double, y1: double, x2: double, y2: double>"
TRACKING_LABELS = (f"name string, video_name string, index long, labels array<struct<id: string, category: string, "
                   f"attributes: map<string, string>, box2d: {BOX2D}>>")


def read_tracking_labels(spark: SparkSession, path: str, attributes: Sequence[str] = (), multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nested label JSON as (boxes, frames).

    ``frame_idx`` numbers the images over all files by (video, index); ``local_frame_idx`` is the
    number after the last dash of the image name; box corners and attributes become columns.
    """
    raw = spark.read.schema(TRACKING_LABELS).option("multiLine", multi_line).json(path)
    local = F.regexp_extract(F.element_at(F.split("name", "-"), -1), r"^(\d+)", 1).cast("long")
    # A frame may have several documents; it is numbered once.
    ordered = positions(raw.select("name", "video_name", "index").distinct(), [F.col("video_name"), F.col("index"), F.col("name")], name="frame_idx")
    frames = ordered.withColumn("local_frame_idx", local)
    labels = raw.select("name", "video_name", "index", F.explode("labels").alias("label"))
    flat = labels.select("name", "video_name", F.col("index").alias("__index"), "label.id", "label.category", "label.box2d.*",
                         *[F.col("label.attributes")[a].alias(a) for a in attributes])
    same = flat["__index"].eqNullSafe(frames["index"])
    keyed = [flat[k].eqNullSafe(frames[k]) for k in ("name", "video_name")]
    return flat.join(frames, [*keyed, same]).drop(flat["name"], flat["video_name"], flat["__index"]), frames


def read_frame_probe(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Probe documents ``{"frames": [...]}`` as one row per frame; packet sizes and offsets as long.

    A file holds one document over many lines, as probes write it, or one per line without
    ``multi_line``.  A document that does not parse fails the read.
    """
    doc = spark.read.schema(f"frames array<struct<{schema}>>").option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    rows = doc.select(F.inline("frames"))
    for c in ("pkt_pos", "pkt_size"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.col(c).cast("long"))
    return rows


def read_telemetry(spark: SparkSession, path: str, schema: str, columns: Sequence[str] = ()) -> DataFrame:
    """Telemetry CSV with a timestamp from its millisecond clock and ``(m/s)`` columns renamed to ``_mps``."""
    t = spark.read.schema(schema).option("header", True).csv(path)
    t = t.withColumn("timestamp", F.timestamp_millis("time"))
    t = t.toDF(*[c.replace("(m/s)", "_mps") for c in t.columns])
    return t.select("timestamp", *columns) if columns else t


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Listing lines ``date time size path`` with a timestamp from the all-digit part of the file name."""
    f = F.split(F.trim("value"), r"\s+")
    base = F.split(F.substring_index(f[3], "/", -1), r"\.")
    digits = F.element_at(F.filter(base, lambda p: p.rlike(r"^\d+$")), 1)
    return spark.read.text(path).select(
        F.to_timestamp(F.concat_ws(" ", f[0], f[1])).alias("date"), f[2].cast("long").alias("byte_size"), f[3].alias("path"),
        F.timestamp_seconds(digits.cast("long")).alias("timestamp"))


def read_cascade_results(spark: SparkSession, path: str, schema: str, least_status: int | None = 2) -> tuple[DataFrame, DataFrame]:
    """Cascade result CSVs as (frames, parameters).

    Frames below ``least_status`` were not part of the test and are left out (None keeps all).

    Two leading ``#`` lines hold ``key: value`` pairs; the file (or the folder of its parts) is
    named ``…_start_end.csv``; frames count from 1 at ``start``.
    """
    start = F.regexp_extract("file", r"_(\d+)_(\d+)\.[^/]*$", 1).cast("long")
    end = F.regexp_extract("file", r"_(\d+)_(\d+)\.[^/]*$", 2).cast("long")
    source = F.regexp_extract(F.input_file_name(), r"^(.*_\d+_\d+\.csv)", 1)
    rows = spark.read.schema(schema).option("comment", "#").csv(path).withColumn("file", source)
    if least_status is not None:
        rows = rows.where(F.col("status") >= least_status)
    frames = rows.withColumn("frame", F.col("frame") - 1 + start)
    head = spark.read.text(path).withColumn("file", source).where(F.col("value").startswith("#") & F.col("value").contains(":"))
    pairs = F.str_to_map(F.regexp_replace(F.regexp_replace("value", r"^#\s*", ""), r"\s*:\s*", ":"), F.lit(r",\s*"), F.lit(":"))
    params = head.select("file", F.explode(pairs)).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("params"))
    return frames, params.withColumns({"start": start, "end": end})


def latest_dump(spark: SparkSession, root: str, date: str | None = None) -> DataFrame:
    """Rows of the newest dump under ``root/<date>/grader<number>.parquet``; a date may be named.

    The newest is found from the paths, so an empty dump counts and only one is read.
    """
    day, number, path = newest_file(spark, root, "grader", date)
    return spark.read.parquet(path).withColumns({"date": F.lit(day), "number": F.lit(number).cast("long")})


def latest_history(spark: SparkSession, root: str, date: str | None = None) -> DataFrame:
    """History rows that belong to the newest dump, with the frame column under one name."""
    day, number, _ = newest_file(spark, root, "grader", date)
    rows = spark.read.parquet(f"{root}/{day}/hist{number}.parquet").withColumns({"date": F.lit(day), "number": F.lit(number).cast("long")})
    for old in ("ilocs", "iloc"):
        if old in rows.columns:
            return rows.withColumn("frame", F.col(old).cast("long"))
    return rows.withColumn("frame", F.col("frame").cast("long"))


def _matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern in whatever store it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath()) for f in found] if found else []


def newest_file(spark: SparkSession, root: str, kind: str, date: str | None = None) -> tuple[str, int, str]:
    """(date, number, path) of the file ``root/<date>/<kind><number>.parquet`` with the largest date and then number."""
    found = []
    for path in _matching(spark, f"{root}/{date or '*'}/{kind}*.parquet"):
        named = re.search(rf"/([^/]+)/{re.escape(kind)}(\d+)\.parquet$", path)
        if named:
            found.append((named[1], int(named[2]), path))
    if not found:
        raise FileNotFoundError(f"no {kind} dump under {root}")
    return max(found)


def dump_results(df: DataFrame, root: str, run: str, number: int) -> None:
    """Append-only, numbered dump of a run; an existing dump is never overwritten."""
    df.write.mode("errorifexists").parquet(f"{root}/run={run}/dump={number}")


def run_missing_clips(clips: DataFrame, out: str, detect: Callable[[DataFrame], DataFrame]) -> None:
    """Detect on the clips (path) that have not been run yet, under ``out``.

    Boxes and the list of finished clips are written under one run name, the list last: a clip
    without detections is finished too, and boxes of a run that failed are never read.
    """
    spark = clips.sparkSession
    ran = finished_clips(spark, out)
    todo = clips.select("path").distinct()
    todo = todo if ran is None else todo.join(ran.select("path"), "path", "left_anti")
    run = uuid.uuid4().hex
    names = f"{out}/todo/{run}"
    todo.write.parquet(names)
    todo = spark.read.parquet(names)
    detect(todo).write.parquet(f"{out}/boxes/run={run}")
    todo.write.parquet(f"{out}/finished/run={run}")


def finished_clips(spark: SparkSession, out: str) -> DataFrame | None:
    """(path, run) of every clip that has been run; None before the first run."""
    return spark.read.parquet(f"{out}/finished") if _matching(spark, f"{out}/finished/*/_SUCCESS") else None


def clip_boxes(spark: SparkSession, out: str) -> DataFrame:
    """Boxes of all finished runs."""
    runs = [re.search(r"run=([^/]+)/_SUCCESS$", p)[1] for p in _matching(spark, f"{out}/finished/*/_SUCCESS")]
    return spark.read.option("basePath", f"{out}/boxes").parquet(*[f"{out}/boxes/run={r}" for r in runs]).drop("run")


def nested_labels(boxes: DataFrame, threshold: float, key: str = "event_id", max_labels: int = 10000) -> DataFrame:
    """One document per (path, frame) with its labels at or above the threshold, frames without any kept.

    A frame with more than ``max_labels`` rows becomes several documents, told apart by ``part``.
    """
    frame = ["path", "frame_id"]
    rows = in_parts(boxes, frame, key, max_labels)
    label = F.struct(F.col(key).alias("id"), "category", F.lit(False).alias("manualShape"), F.lit(False).alias("manualAttributes"),
                     F.col("confidence").alias("score"), F.struct(*[F.col(c).alias(n) for c, n in zip(("xmin", "ymin", "xmax", "ymax"), ("x1", "y1", "x2", "y2"))]).alias("box2d"))
    docs = rows.groupBy(*frame, "part").agg(
        F.max("height").alias("height"), F.max("width").alias("width"), F.min("video_name").alias("video_name"),
        F.array_sort(F.collect_list(F.when(F.col("confidence") >= threshold, label))).alias("labels"))
    return docs.withColumn("name", F.col("path"))


def coco_tables(documents: DataFrame, classes: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, images, annotations) of nested label documents.

    Category ids follow the list; images are numbered from 1 in (name, frame) order before empty ones
    are dropped; annotations are numbered from 0 in image and label order.
    """
    spark = documents.sparkSession
    categories = spark.createDataFrame([(i, c, "none") for i, c in enumerate(classes)], "id int, name string, supercategory string")
    ids = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    # An image may have several documents (parts); it is numbered once, and its labels follow part by part.
    parts = F.col("part") if "part" in documents.columns else F.lit(0)
    one = documents.groupBy("name", "frame_id").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    numbered = positions(one, [F.col("name"), F.col("frame_id")], name="__pos")
    images = numbered.select((F.col("__pos") + 1).alias("id"), F.substring_index("name", "/", -1).alias("file_name"), "name", "frame_id",
                             F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"))
    labels = documents.select("name", "frame_id", parts.alias("part"), F.posexplode("labels").alias("at", "label")).withColumn("category_id", ids[F.col("label.category")])
    known = labels.where(F.col("category_id").isNotNull()).join(images.select("name", "frame_id", F.col("id").alias("image_id")), ["name", "frame_id"])
    ranked = positions(known, [F.col("image_id"), F.col("part"), F.col("at")], name="id")
    b = [F.col(f"label.box2d.{c}") for c in ("x1", "y1", "x2", "y2")]
    annotations = ranked.select(
        "id", "image_id", "category_id", F.lit(0).alias("iscrowd"), F.lit(0).alias("ignore"),
        F.array(b[0], b[1], b[2] - b[0], b[3] - b[1]).alias("bbox"), ((b[2] - b[0]) * (b[3] - b[1])).alias("area"),
        F.array(F.array(b[0], b[1], b[0], b[3], b[2], b[3], b[2], b[1])).alias("segmentation"), F.col("label.score").alias("score"))
    used = images.join(annotations.select(F.col("image_id").alias("id")).distinct(), "id", "left_semi").drop("name", "frame_id")
    return categories, used, annotations


def detector_arrays(outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arrays of boxes, scores and classes per image as box rows."""
    zipped = outputs.select(*keys, F.explode(F.arrays_zip("boxes", "scores", "classes")).alias("d"))
    box = F.col("d.boxes")
    return zipped.select(*keys, *[box[i].alias(n) for i, n in enumerate(("minx", "miny", "maxx", "maxy"))],
                         F.col("d.scores").alias("score"), F.col("d.classes").alias("label"))


def export_batches(rows: DataFrame, key: str, batch_size: int, path: str) -> None:
    """Rows in folders of ``batch_size`` consecutive keys."""
    batched = rows.withColumn("batch", F.floor(F.col(key) / batch_size))
    batched.repartitionByRange("batch").write.partitionBy("batch").parquet(path)

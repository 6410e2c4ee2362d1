"""Detection-style views over the given tables: as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.operators import prep

CATEGORIES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id",
        (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600) - 2840112).cast("long").alias("frame_id"),
        F.col("user_id").alias("track_id"),
        F.col("event_type").alias("category"),
        (F.col("value") / (F.col("value") + F.lit(50.0))).alias("confidence"),
    )
    e = e.withColumn("xmin", ((F.col("track_id") * 37) % 900 + (F.col("frame_id") % 7) * 2).cast("double"))
    e = e.withColumn("ymin", ((F.col("track_id") * 53) % 500 + (F.col("frame_id") % 5) * 2).cast("double"))
    return (
        e.withColumn("xmax", F.col("xmin") + 40 + (F.col("track_id") % 8) * 10)
        .withColumn("ymax", F.col("ymin") + 40 + (F.col("track_id") % 5) * 10)
        .withColumn("chunk_id", F.floor(F.col("frame_id") / 144).cast("int"))
        .withColumn("split", split_of(F.col("frame_id")))
    )


def split_of(frame):
    return F.when(frame % 10 == 0, "train").when(frame % 10 == 1, "val").otherwise("test")


def det_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.floor((F.col("track_id") % 30) * (F.col("track_id") % 30) / 34).cast("int")
    return det(spark, sf_dir).where(F.col("chunk_id").between(h, h + 3))


def video_len(spark: SparkSession, sf_dir: str) -> int:
    """Frames of the axis: up to the last one with a detection."""
    return det(spark, sf_dir).agg(F.coalesce(F.max("frame_id") + 1, F.lit(0))).first()[0]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.range(video_len(spark, sf_dir)).withColumnRenamed("id", "frame_id")
    return f.withColumn("chunk_id", F.floor(F.col("frame_id") / 144).cast("int")).withColumn(
        "split", split_of(F.col("frame_id"))
    )


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).where(F.col("split").isin("train", "val")).select("frame_id")


def usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.usable_boxes(det(spark, sf_dir), excluded(spark, sf_dir), CATEGORIES)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(spark, sf_dir).select("category", "frame_id", "track_id").distinct()


def det_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_partkey").alias("track_id"),
        F.col("l_returnflag").alias("category"),
    )


def frames_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best confidence per (frame, category), 0 where the frame has none."""
    best = det(spark, sf_dir).groupBy("frame_id", "category").agg(F.max("confidence").alias("score"))
    grid = frames(spark, sf_dir).select("frame_id", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    return grid.join(best, ["frame_id", "category"], "left").fillna(0.0, ["score"])


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("patch_id"),
        F.floor(F.col("vec_id") / 5).cast("long").alias("frame_id"),
        "embedding",
        F.col("label").cast("long").alias("label"),
        (F.col("label") == 0).cast("int").alias("y"),
    )


# The same views as common table expressions, each naming the views it reads.
_SQL = {
    "det": ("""det AS (
  SELECT *, cast(floor(frame_id/144) AS int) AS chunk_id,
    CASE WHEN frame_id%10=0 THEN 'train' WHEN frame_id%10=1 THEN 'val' ELSE 'test' END AS split,
    xmin + 40 + (track_id%8)*10 AS xmax, ymin + 40 + (track_id%5)*10 AS ymax
  FROM (SELECT *, cast((track_id*37)%900 + (frame_id%7)*2 AS double) AS xmin,
               cast((track_id*53)%500 + (frame_id%5)*2 AS double) AS ymin
        FROM (SELECT event_id, cast(floor(epoch(ts)/600) AS bigint) - 2840112 AS frame_id,
                     user_id AS track_id, event_type AS category, value/(value+50.0) AS confidence
              FROM events)))""", ()),
    "det_skew": ("""det_skew AS (
  SELECT * FROM det WHERE chunk_id BETWEEN cast(floor((track_id%30)*(track_id%30)/34) AS int)
                              AND cast(floor((track_id%30)*(track_id%30)/34) AS int) + 3)""", ("det",)),
    "frames": ("""frames AS (
  SELECT i AS frame_id, cast(floor(i/144) AS int) AS chunk_id,
    CASE WHEN i%10=0 THEN 'train' WHEN i%10=1 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT unnest(range((SELECT max(frame_id) + 1 FROM det))) AS i))""", ("det",)),
    "usable": ("""usable AS (
  SELECT * FROM det WHERE split = 'test' AND track_id IN (
    SELECT track_id FROM det GROUP BY category, track_id HAVING count(*) >= 3))""", ("det",)),
    "hits": ("hits AS (SELECT DISTINCT category, frame_id, track_id FROM usable)", ("usable",)),
    "scores": ("""scores AS (
  SELECT f.frame_id, c.category, coalesce(m.score, 0.0) AS score
  FROM frames f CROSS JOIN (SELECT DISTINCT category FROM det) c
  LEFT JOIN (SELECT frame_id, category, max(confidence) AS score FROM det GROUP BY ALL) m
    ON m.frame_id = f.frame_id AND m.category = c.category)""", ("frames", "det")),
    "det_big": ("""det_big AS (
  SELECT l_orderkey AS frame_id, l_partkey AS track_id, l_returnflag AS category FROM lineitem)""", ()),
    "patches": ("""patches AS (
  SELECT vec_id AS patch_id, cast(floor(vec_id/5) AS bigint) AS frame_id, embedding,
         cast(label AS bigint) AS label, cast(label = 0 AS int) AS y FROM embeddings)""", ()),
}


def define(name: str, sql: str, *needs: str) -> None:
    """Add a view other queries' SQL can name."""
    _SQL[name] = (f"{name} AS ({sql})", needs)


def with_views(*names: str, body: str, extra: str = "") -> str:
    """``WITH`` clause over the named views and what they read, then ``extra`` views, then ``body``."""
    ordered: list[str] = []

    def add(n):
        for d in _SQL[n][1]:
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    parts = [_SQL[n][0] for n in ordered] + ([extra] if extra else [])
    return f"WITH {', '.join(parts)}\n{body}" if parts else body

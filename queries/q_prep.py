from pyspark.sql import functions as F

from framesift.functions.ordinal import seed_key
from framesift.operators import chunking, prep
from framesift.session import scratch_path
from framesift.sources import dataset as D
from queries.registry import query
from queries.views import CATEGORIES, det, det_big, excluded, frames, hits, table, usable, video_len, with_views


@query("S1_read_by_extension", "SELECT 'parquet' AS kind, count(*) AS n, cast(sum(event_id) AS bigint) AS ids FROM events "
       "UNION ALL SELECT 'csv', count(*), cast(sum(event_id) AS bigint) FROM events")
def s1(spark, d):
    path = scratch_path(spark, "boxes") + ".csv"
    src = D.read_data(spark, f"{d}/events.parquet").select("event_id", "user_id")
    src.write.option("header", True).csv(path)
    agg = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"),
                                  F.sum("event_id").cast("long").alias("ids"))
    return agg(src, "parquet").unionByName(agg(D.read_data(spark, path, "event_id long, user_id long"), "csv"))


@query("S2_standardize_boxes", with_views("det", body="""
SELECT cast(dense_rank() OVER (ORDER BY track_id) - 1 AS bigint) AS track_id, frame_id, category FROM det"""))
def s2(spark, d):
    return D.standardize_boxes(D.Dataset("det", "", track_id="track_id"), det(spark, d))


@query("S3_unicode_columns", with_views("det", body="SELECT frame_id, track_id FROM det"))
def s3(spark, d):
    path = scratch_path(spark, "bytes")
    det(spark, d).select(F.col("frame_id").alias("b'frame_id'"), F.col("track_id").alias("b'track_id'")).write.parquet(path)
    return D.unicode_columns(spark.read.parquet(path))


@query("P1_composite_key", with_views("det", body="""
SELECT category || '_' || cast(chunk_id AS varchar) AS task, count(*) AS n FROM det GROUP BY 1"""))
def p1(spark, d):
    return det(spark, d).groupBy(prep.composite("category", "chunk_id").alias("task")).agg(F.count(F.lit(1)).alias("n"))


@query("P2_remove_excluded", with_views("frames", body="SELECT frame_id FROM frames WHERE split NOT IN ('train','val')"))
def p2(spark, d):
    return prep.remove_frames(frames(spark, d).select("frame_id"), excluded(spark, d))


@query("P3_valid_tracks", with_views("det", body="""
SELECT DISTINCT track_id FROM (SELECT category, track_id FROM det GROUP BY ALL HAVING count(*) >= 3)"""))
def p3(spark, d):
    return prep.valid_tracks(det(spark, d))


@query("P3_valid_tracks_large", with_views("det_big", body="""
SELECT DISTINCT track_id FROM (SELECT category, track_id FROM det_big GROUP BY ALL HAVING count(*) >= 3)"""))
def p3_large(spark, d):
    return prep.valid_tracks(det_big(spark, d))


@query("P4_usable_boxes", with_views("usable", body="SELECT event_id, frame_id, track_id, category FROM usable"))
def p4(spark, d):
    return usable(spark, d).select("event_id", "frame_id", "track_id", "category")


@query("K1_fixed_duration_chunks", with_views("frames", body="""
SELECT frame_id, cast(floor(frame_id/1800) AS bigint) AS chunk_id FROM frames"""))
def k1(spark, d):
    return chunking.chunk_map(frames(spark, d), "1 minute")


@query("K2_chunk_selectors", with_views("frames", "det", body="""
SELECT 'nosplit' AS selector, cast(0 AS bigint) AS chunk_id, count(*) AS n FROM frames
UNION ALL SELECT 'default', cast(chunk_id AS bigint), count(*) FROM frames GROUP BY 2
UNION ALL SELECT 'boxes in nosplit', cast(0 AS bigint), count(*) FROM det"""))
def k2(spark, d):
    f = frames(spark, d)
    count = lambda m, s: m.groupBy(F.lit(s).alias("selector"), F.col("chunk_id").cast("long").alias("chunk_id")).agg(
        F.count(F.lit(1)).alias("n"))
    none = chunking.chunk_map(f, "nosplit")
    boxes = det(spark, d).select("frame_id").join(none, "frame_id")
    return (count(none, "nosplit").unionByName(count(chunking.chunk_map(f, "default", default=f), "default"))
            .unionByName(count(boxes, "boxes in nosplit")))


@query("K3_side_table_chunks", """
SELECT o_orderkey AS frame_id, cast(dense_rank() OVER (ORDER BY date_trunc('month', o_orderdate)) - 1 AS bigint) AS chunk_id
FROM orders""")
def k3(spark, d):
    side = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("frame_id"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))
    return chunking.side_table_chunks(side, "month")


@query("K4_box_column_chunks", with_views("det", body="""
SELECT frame_id, cast(dense_rank() OVER (ORDER BY v) - 1 AS bigint) AS chunk_id
FROM (SELECT frame_id, arg_min(category, event_id) AS v FROM det GROUP BY 1)"""))
def k4(spark, d):
    return chunking.box_column_chunks(det(spark, d), "category", "event_id")


@query("K5_time_grid_chunks", """
SELECT event_id, cast(round_even((epoch(ts)::bigint + 613)/1800.0, 0)*1800 - 613 AS bigint) AS grid_start
FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def k5(spark, d):
    e = table(spark, d, "events")
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("event_id", chunking.time_grid(sec, 1800, 613).alias("grid_start"))


def _k6_sql(quantile):
    cuts = ("SELECT list(DISTINCT v) AS cuts FROM (SELECT unnest(quantile_cont(value, [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1])) AS v FROM events)"
            if quantile else
            "SELECT [lo + i*((hi-lo)/20) FOR i IN range(20)] AS cuts FROM (SELECT min(value) AS lo, max(value) AS hi FROM events)")
    return f"""WITH c AS ({cuts})
SELECT event_id, round(coalesce(list_min(list_filter(cuts, lambda x: x >= value)), 'inf'::double), 6) AS bucket FROM events, c"""


@query("K6_value_buckets_quantile", _k6_sql(True))
def k6q(spark, d):
    return chunking.value_buckets(table(spark, d, "events"), "value", 20).select("event_id", F.round("bucket", 6).alias("bucket"))


@query("K6_value_buckets_width", _k6_sql(False).replace("round(coalesce", "coalesce").replace(", 'inf'::double), 6)", ", 'inf'::double)"))
def k6w(spark, d):
    return chunking.value_buckets(table(spark, d, "events"), "value", 20, quantile=False).select("event_id", "bucket")


@query("K7_prefix_chunks", """
SELECT o_orderkey, cast(dense_rank() OVER (ORDER BY split_part(o_orderpriority, '-', 1)) - 1 AS bigint) AS chunk_id FROM orders""")
def k7(spark, d):
    return chunking.prefix_chunks(table(spark, d, "orders"), "o_orderpriority").select("o_orderkey", "chunk_id")


@query("K8_contiguous_parts", with_views("det", body="""
SELECT cast(floor(frame_id / ceil((SELECT max(frame_id) + 1 FROM det) / 7)) AS bigint) AS part, count(*) AS n, min(frame_id) AS first, max(frame_id) AS last FROM det GROUP BY 1"""))
def k8(spark, d):
    return det(spark, d).groupBy(chunking.contiguous_parts(F.col("frame_id"), video_len(spark, d), 7).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_id").alias("first"), F.max("frame_id").alias("last"))


@query("K9_arrival_codes", with_views("det", body="""
SELECT track_id, cast(row_number() OVER (ORDER BY f, track_id) - 1 AS bigint) AS code
FROM (SELECT track_id, min(event_id) AS f FROM det GROUP BY 1)"""))
def k9(spark, d):
    return prep.arrival_codes(det(spark, d), "track_id", "event_id")


@query("K10_dense_tracks", with_views("usable", body="""
SELECT category, track_id, cast(dense_rank() OVER (PARTITION BY category ORDER BY track_id) - 1 AS bigint) AS dense_id
FROM (SELECT DISTINCT category, track_id FROM usable)"""))
def k10(spark, d):
    return prep.dense_tracks(usable(spark, d))


@query("K11_tracks_of_frames", with_views("frames", "hits", body="""
SELECT f.frame_id, 0 AS part, coalesce(t, '') AS tracks, coalesce(n, 0) AS n FROM frames f LEFT JOIN (
  SELECT frame_id, string_agg(cast(track_id AS varchar), ',' ORDER BY track_id) AS t, count(*) AS n
  FROM hits WHERE category = 'click' GROUP BY 1) h ON h.frame_id = f.frame_id"""))
def k11(spark, d):
    h = hits(spark, d).where(F.col("category") == "click")
    return prep.tracks_of_frames(h, frames(spark, d).select("frame_id")).select(
        "frame_id", "part", F.concat_ws(",", F.col("tracks").cast("array<string>")).alias("tracks"), F.size("tracks").cast("long").alias("n"))


@query("K12_interval_frames", """
SELECT frame_id, count(*) AS n, cast(sum(track_id) AS bigint) AS tracks FROM (
  SELECT track_id, unnest(range(s, e)) AS frame_id FROM (
    SELECT o_orderkey AS track_id, cast(date_diff('day', DATE '1992-01-01', cast(o_orderdate AS date)) AS bigint) AS s,
           cast(date_diff('day', DATE '1992-01-01', cast(o_orderdate AS date)) + o_custkey % 20 AS bigint) AS e FROM orders))
GROUP BY 1""")
def k12(spark, d):
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("track_id"), start.alias("start"), (start + F.col("o_custkey") % 20).alias("end"))
    return prep.interval_frames(o).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("track_id").alias("tracks"))


@query("K13_frame_label_arrays", with_views("frames", "usable", extra="""coded AS (
  SELECT frame_id, category, dense_rank() OVER (PARTITION BY category ORDER BY track_id) AS c FROM usable),
lists AS (SELECT frame_id, category, string_agg(cast(c AS varchar), ',' ORDER BY c) AS t FROM coded GROUP BY ALL)""", body="""
SELECT f.frame_id, 0 AS part, max(CASE WHEN category='click' THEN t END) AS click, max(CASE WHEN category='error' THEN t END) AS error,
  max(CASE WHEN category='purchase' THEN t END) AS purchase, max(CASE WHEN category='signup' THEN t END) AS signup,
  max(CASE WHEN category='view' THEN t END) AS "view"
FROM frames f LEFT JOIN lists l ON l.frame_id = f.frame_id GROUP BY 1"""))
def k13(spark, d):
    wide = prep.frame_label_arrays(usable(spark, d), frames(spark, d), CATEGORIES)
    text = lambda c: F.when(F.col(c).isNotNull() & (F.size(c) > 0), F.concat_ws(",", F.col(c).cast("array<string>"))).alias(c)
    return wide.select("frame_id", "part", *[text(c) for c in CATEGORIES])


@query("K14_group_offsets", """
SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) OVER (PARTITION BY l_orderkey) AS gop_offset FROM lineitem""")
def k14(spark, d):
    p = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("gop_number"), "l_linenumber", "l_partkey", F.col("l_suppkey").alias("byte_offset"))
    return chunking.group_offsets(p).select(F.col("gop_number").alias("l_orderkey"), "l_linenumber", "l_partkey", "gop_offset")


@query("K15_stratified_folds", with_views("patches", body="""
SELECT frame_id, cast(label AS bigint) AS label, cast((row_number() OVER (PARTITION BY label ORDER BY md5('7:' || frame_id)) - 1) % 5 AS int) AS fold
FROM (SELECT frame_id, max(y) AS label FROM patches GROUP BY 1)"""))
def k15(spark, d):
    from queries.views import patches
    images = chunking.image_label(patches(spark, d), "frame_id", ["y"])
    return chunking.stratified_folds(images, "frame_id", "label", 5, 7).select("frame_id", F.col("label").cast("long").alias("label"), "fold")


@query("A1_track_totals", with_views("usable", body="SELECT category, track_id, count(*) AS track_length FROM usable GROUP BY ALL"))
def a1(spark, d):
    return prep.track_totals(usable(spark, d))


@query("A2_track_length_frequency", with_views("det_big", body="""
SELECT category, track_length, count(*) AS freq FROM (
  SELECT category, track_id, count(*) AS track_length FROM det_big GROUP BY ALL) GROUP BY ALL"""))
def a2(spark, d):
    return prep.track_length_frequency(det_big(spark, d))


@query("Q11_category_totals", with_views("hits", "frames", body="""
SELECT category, count(DISTINCT track_id) AS total_ni, (SELECT count(*) FROM frames WHERE split = 'test') AS total_nf FROM hits GROUP BY 1"""))
def q11(spark, d):
    return prep.category_totals(usable(spark, d), frames(spark, d), excluded(spark, d))

from pyspark.sql import functions as F

from framesift.functions.hooks import detector_stage, score_column, transformed
from framesift.functions.ordinal import in_parts
from framesift.plans import evaluate as ev
from framesift.session import scratch_path
from framesift.sources import files as S
from queries import views
from queries.q_stats import rounded
from queries.registry import query
from queries.views import CATEGORIES, det, table, with_views

BOX = ("xmin", "ymin", "xmax", "ymax")


def label_files(spark, d):
    x = det(spark, d)
    label = F.struct(F.col("track_id").cast("string").alias("id"), "category",
                     F.create_map(F.lit("crowd"), (F.col("track_id") % 2).cast("string")).alias("attributes"),
                     F.struct(*[F.col(c).alias(n) for c, n in zip(BOX, ("x1", "y1", "x2", "y2"))]).alias("box2d"))
    doc = in_parts(x, ["frame_id"], "event_id", 10000).groupBy("frame_id", "chunk_id", "part").agg(F.collect_list(label).alias("labels")).select(
        F.format_string("clip-%02d-%07d.jpg", "chunk_id", F.col("frame_id") % 144).alias("name"),
        F.format_string("clip-%02d", "chunk_id").alias("video_name"), (F.col("frame_id") % 144).alias("index"), "labels")
    path = scratch_path(spark, "labels")
    doc.write.json(path)
    return path


views.define("ord", "SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS frame_idx FROM (SELECT DISTINCT frame_id FROM det)", "det")


@query("S4_tracking_labels", with_views("ord", body="""
SELECT cast(track_id AS varchar) AS id, category, cast(track_id % 2 AS varchar) AS crowd, frame_idx, det.frame_id % 144 AS local_frame_idx, xmin AS x1, ymax AS y2
FROM det JOIN ord ON ord.frame_id = det.frame_id"""))
def s4(spark, d):
    boxes, _ = S.read_tracking_labels(spark, label_files(spark, d), ["crowd"])
    return boxes.select("id", "category", "crowd", "frame_idx", "local_frame_idx", "x1", "y2")


@query("S4_tracking_frames", with_views("ord", body="""
SELECT printf('clip-%02d-%07d.jpg', cast(floor(frame_id/144) AS int), frame_id % 144) AS name, frame_idx, frame_id % 144 AS local_frame_idx FROM ord"""))
def s4_frames(spark, d):
    return S.read_tracking_labels(spark, label_files(spark, d))[1].select("name", "frame_idx", "local_frame_idx")


@query("S5_frame_probe", """SELECT l_orderkey AS coded_picture_number, l_partkey AS pkt_pos, l_suppkey AS pkt_size FROM lineitem""")
def s5(spark, d):
    path = scratch_path(spark, "probe")
    li = table(spark, d, "lineitem")
    frame = F.struct(F.col("l_orderkey").alias("coded_picture_number"), F.col("l_partkey").cast("string").alias("pkt_pos"),
                     F.col("l_suppkey").cast("string").alias("pkt_size"))
    # Some hundred rows a document, each in a file of its own and spread over many lines.
    docs = li.groupBy(F.floor(F.col("l_orderkey") / 400)).agg(F.to_json(F.struct(F.collect_list(frame).alias("frames"))).alias("value"))
    docs.select(F.regexp_replace("value", r"([\[{,])", "$1\n").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return S.read_frame_probe(spark, path, "coded_picture_number: bigint, pkt_pos: string, pkt_size: string")


@query("S6_telemetry", """SELECT epoch_us(ts) // 1000 AS ms, user_id AS trip_id, value AS speed_mps FROM events""")
def s6(spark, d):
    path = scratch_path(spark, "telemetry")
    e = table(spark, d, "events")
    e.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), F.col("user_id").alias("trip_id"),
             F.col("value").alias("speed(m/s)")).write.option("header", True).csv(path)
    t = S.read_telemetry(spark, path, "time long, trip_id long, `speed(m/s)` double", ["trip_id", "speed_mps"])
    return t.select(F.unix_millis("timestamp").alias("ms"), "trip_id", "speed_mps")


@query("S7_listing", """SELECT o_custkey AS byte_size, 'dir/clip.' || (epoch(o_orderdate)::bigint + o_orderkey) || '.mov' AS path,
  epoch(o_orderdate)::bigint AS written, epoch(o_orderdate)::bigint + o_orderkey AS taken FROM orders""")
def s7(spark, d):
    path = scratch_path(spark, "listing")
    o = table(spark, d, "orders").withColumn("t", F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    o.select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("   "), F.col("o_custkey"), F.lit(" dir/clip."),
                      F.col("t") + F.col("o_orderkey"), F.lit(".mov"))).write.text(path)
    rows = S.read_listing(spark, path)
    return rows.select("byte_size", "path", F.unix_seconds("date").alias("written"), F.unix_seconds("timestamp").alias("taken"))


@query("S8_cascade_results", with_views("det", body="""
SELECT frame_id + 1000 AS frame, CASE WHEN confidence > 0.5 THEN 6 ELSE 2 END AS status, 0.25::double AS diff_thresh, 'm.pb' AS model, 1000::bigint AS start, 9000::bigint AS "end" FROM det WHERE confidence > 0.25"""))
def s8(spark, d):
    path = scratch_path(spark, "cascade")
    x = det(spark, d).select((F.col("frame_id") + 1).cast("string").alias("a"), F.when(F.col("confidence") > 0.5, 6).when(F.col("confidence") > 0.25, 2).otherwise(0).cast("string").alias("b"))
    lines = x.agg(F.lit(None).alias("v")).select(F.explode(F.array(F.lit("# diff_thresh: 0.25, skip: 1"), F.lit("# model: m.pb"))).alias("value"))
    body = x.select(F.concat_ws(",", "a", "b").alias("value"))
    lines.unionByName(body).write.text(f"{path}/test_1000_9000.csv")
    frames, params = S.read_cascade_results(spark, f"{path}/test_1000_9000.csv", "frame long, status int")
    p = params.select("file", F.col("params")["diff_thresh"].cast("double").alias("diff_thresh"), F.col("params")["model"].alias("model"), "start", "end")
    return frames.join(p, "file").drop("file")


@query("S9_S10_latest_dump", with_views("det", body="SELECT event_id, 3 AS dump, '2024-02-02' AS date, 12::bigint AS number FROM det"))
def s9(spark, d):
    root = scratch_path(spark, "dumps")
    x = det(spark, d).select("event_id")
    for i, (date, n) in enumerate([("2024-01-01", 40), ("2024-02-02", 3), ("2024-02-02", 9), ("2024-02-02", 12)]):
        x.withColumn("dump", F.lit(i)).write.parquet(f"{root}/{date}/grader{n}.parquet")
    return S.latest_dump(spark, root)


@query("S9_latest_history", with_views("det", body="SELECT event_id AS frame, 1 AS dump FROM det"))
def s9_history(spark, d):
    root = scratch_path(spark, "dumps")
    x = det(spark, d).select("event_id", F.col("event_id").cast("int").alias("iloc"))
    for i, n in enumerate((3, 11)):
        for kind in ("grader", "hist"):
            x.withColumn("dump", F.lit(i)).write.parquet(f"{root}/2024-05-05/{kind}{n}.parquet")
    return S.latest_history(spark, root).select("frame", "dump")


@query("S10_dump_results", with_views("det", body="SELECT category, count(*) AS n, 'a' AS run, 0 AS dump FROM det GROUP BY 1"))
def s10(spark, d):
    root = scratch_path(spark, "runs")
    S.dump_results(det(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n")), root, "a", 0)
    return spark.read.parquet(root)


@query("S11_missing_clips", with_views("det", body="SELECT 'clip' || chunk_id AS path, count(*) AS n FROM det GROUP BY 1"))
def s11(spark, d):
    out = scratch_path(spark, "clips")
    x = det(spark, d).select(F.concat(F.lit("clip"), F.col("chunk_id")).alias("path"), "event_id")
    clips = x.select("path").distinct()
    detect = lambda todo: x.join(todo, "path", "left_semi")
    S.run_missing_clips(clips.where("path < 'clip2'"), out, detect)
    S.run_missing_clips(clips, out, detect)
    S.run_missing_clips(clips, out, detect)
    return S.clip_boxes(spark, out).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def documents(spark, d, threshold=0.5):
    x = det(spark, d).withColumns({"path": F.concat(F.lit("dir/clip"), F.col("chunk_id")), "height": F.lit(720), "width": F.lit(1280),
                                   "video_name": F.col("chunk_id").cast("string")})
    return S.nested_labels(x, threshold)


@query("S12_nested_labels", with_views("det", body="""
SELECT 'dir/clip' || chunk_id AS name, frame_id, count(*) FILTER (confidence >= 0.5) AS labels,
  coalesce(string_agg(cast(event_id AS varchar), ',' ORDER BY event_id) FILTER (confidence >= 0.5), '') AS ids FROM det GROUP BY ALL"""))
def s12(spark, d):
    path = scratch_path(spark, "nested")
    documents(spark, d).write.json(path)
    back = spark.read.schema("name string, frame_id long, labels array<struct<id: bigint, score: double>>").json(path)
    return back.select("name", "frame_id", F.size("labels").cast("long").alias("labels"),
                       F.concat_ws(",", F.transform("labels", lambda x: x["id"].cast("string"))).alias("ids"))


COCO = """doc AS (SELECT *, 'dir/clip' || chunk_id AS name FROM det),
img AS (SELECT name, frame_id, row_number() OVER (ORDER BY name, frame_id) AS id FROM (SELECT DISTINCT name, frame_id FROM doc)),
ann AS (SELECT row_number() OVER (ORDER BY i.id, event_id) - 1 AS id, i.id AS image_id, CASE category WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS category_id, doc.*
  FROM doc JOIN img i ON i.name = doc.name AND i.frame_id = doc.frame_id WHERE category IN ('view', 'click', 'error') AND confidence >= 0.5)"""


@query("S13_coco_annotations", with_views("det", extra=COCO, body="""
SELECT id, image_id, category_id, xmin || ',' || (xmax-xmin) AS box, (xmax-xmin)*(ymax-ymin) AS area, round(confidence, 8) AS score FROM ann"""))
def s13(spark, d):
    _, _, ann = S.coco_tables(documents(spark, d), ["view", "click", "error"])
    return rounded(ann.select("id", "image_id", "category_id", F.concat_ws(",", F.col("bbox")[0].cast("string"), F.col("bbox")[2].cast("string")).alias("box"), "area", "score"), "score", places=8)


@query("S13_coco_images", with_views("det", extra=COCO, body="""
SELECT id, 'clip' || split_part(name, 'clip', 2) AS file_name, 720 AS height, 1280 AS width FROM img WHERE id IN (SELECT image_id FROM ann)"""))
def s13_images(spark, d):
    return S.coco_tables(documents(spark, d), ["view", "click", "error"])[1]


@query("S14_detector_arrays", with_views("det", body="SELECT frame_id, xmin AS minx, ymin AS miny, xmax AS maxx, ymax AS maxy, round(confidence, 8) AS score, category AS label FROM det"))
def s14(spark, d):
    one = F.struct("event_id", F.array(*BOX).alias("box"), "confidence", "category")
    outputs = in_parts(det(spark, d), ["frame_id"], "event_id", 10000).groupBy("frame_id", "part").agg(F.array_sort(F.collect_list(one)).alias("o")).select(
        "frame_id", F.col("o.box").alias("boxes"), F.col("o.confidence").alias("scores"), F.col("o.category").alias("classes"))
    return rounded(S.detector_arrays(outputs, ["frame_id"]), "score", places=8)


@query("S15_export_batches", "SELECT cast(floor(o_orderkey/1000) AS int) AS batch, count(*) AS n FROM orders GROUP BY 1")
def s15(spark, d):
    path = scratch_path(spark, "batches")
    S.export_batches(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, path)
    return spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("F1_detector_hook", with_views("det", body="""
SELECT event_id, 'wide' AS category, round((xmax-xmin)/(xmax-xmin+ymax-ymin), 8) AS confidence FROM det WHERE xmax-xmin > ymax-ymin"""))
def f1(spark, d):
    def load():
        names = {True: "wide", False: "tall"}

        def model(pdf):
            w, h = pdf["xmax"] - pdf["xmin"], pdf["ymax"] - pdf["ymin"]
            return pdf[["event_id"]].assign(category=(w > h).map(names), confidence=w / (w + h))[w > h]

        return model

    boxes = detector_stage(det(spark, d).select("event_id", *BOX), load, "event_id long, category string, confidence double")
    return rounded(boxes, "confidence", places=8)


@query("F3_score_column", with_views("det", body="SELECT event_id, round(0.7 * confidence + 0.3 * (xmin / 1000), 6) AS score FROM det"))
def f3(spark, d):
    def scorer(conf: "pd.Series", x: "pd.Series") -> "pd.Series":  # noqa: F821
        return 0.7 * conf + 0.3 * (x / 1000)

    import pandas as pd
    scorer.__annotations__ = {"conf": pd.Series, "x": pd.Series, "return": pd.Series}
    return rounded(score_column(det(spark, d), ["confidence", "xmin"], scorer).select("event_id", "score"), "score")


@query("F4_composed_transforms", with_views("det", body="""
SELECT event_id, round((ymax-ymin)/(xmax-xmin), 8) AS ratio FROM det WHERE confidence > 0.5 AND category = 'view'"""))
def f4(spark, d):
    from framesift.operators.detections import box_shapes, confident
    steps = (confident, lambda df: df.where("category = 'view'"), box_shapes, lambda df: df.select("event_id", "ratio"))
    return rounded(transformed(det(spark, d), *steps), "ratio", places=8)


@query("F5_V7_aggregate_columns", """
SELECT o_orderpriority, round(exp(avg(ln(o_totalprice))), 4) AS gmean, round(quantile_cont(o_totalprice, 0.9), 4) AS q90 FROM orders GROUP BY 1""")
def f5(spark, d):
    from framesift.functions.ordinal import exact_quantiles
    o = table(spark, d, "orders")
    g = o.groupBy("o_orderpriority").agg(ev.geometric_mean("o_totalprice").alias("gmean"))
    q = exact_quantiles(o, "o_totalprice", [0.9], by=["o_orderpriority"]).select("o_orderpriority", F.col("value").alias("q90"))
    return rounded(g.join(q, "o_orderpriority"), "gmean", "q90", places=4)

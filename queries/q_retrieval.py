from pyspark.sql import functions as F

from framesift.operators import metrics, stats
from framesift.operators import retrieval as R
from framesift.operators import tracking as K
from framesift.session import cut_lineage, scratch_path
from framesift.streaming import live
from queries import views
from queries.q_detections import linker_sql, recursive
from queries.q_stats import rounded
from queries.registry import query
from queries.views import det, hits, patches, table, with_views


@query("R1_frame_features", with_views("patches", body="""
SELECT frame_id, cast(i AS int) AS i, round(avg(v), 6) AS v FROM (SELECT frame_id, unnest(embedding)::double AS v, unnest(range(64)) AS i FROM patches) GROUP BY ALL"""))
def r1(spark, d):
    f = R.frame_features(patches(spark, d))
    return f.select("frame_id", F.posexplode("feature").alias("i", "v")).withColumn("v", F.round("v", 6))


def truth(spark, d):
    return patches(spark, d).groupBy("frame_id").agg(F.max("y").alias("y"))


@query("R2_R3_score_frames")
def r2(spark, d):
    p = patches(spark, d)
    labelled = R.frame_features(p).join(truth(spark, d), "frame_id")
    return R.score_frames(p, R.fit(labelled, "feature"))


@query("R4_feedback_round")
def r4(spark, d):
    p = patches(spark, d)
    first = R.feedback_round(p, R.frame_features(p), truth(spark, d), None, 20, 0)
    return R.feedback_round(p, R.frame_features(p), truth(spark, d), first, 9, 1)


@query("R5_search_by_example")
def r5(spark, d):
    return R.search_by_example(patches(spark, d), truth(spark, d), wanted=20, batch=15)


MODELS = "models AS (SELECT label AS model_id, CASE WHEN label = 3 THEN NULL ELSE embedding END AS weights, label / 10.0::double AS intercept FROM patches WHERE patch_id IN (SELECT min(patch_id) FROM patches GROUP BY label))"


def models(spark, d):
    p = patches(spark, d)
    first = p.groupBy("label").agg(F.min_by(F.col("embedding").cast("array<double>"), "patch_id").alias("weights"))
    return first.select(F.col("label").alias("model_id"), F.when(F.col("label") != 3, F.col("weights")).alias("weights"), (F.col("label") / 10).alias("intercept"))


@query("R6_many_models", with_views("patches", extra=MODELS, body="""
SELECT patch_id, model_id, round(CASE WHEN weights IS NULL THEN 0 ELSE 1/(1+exp(-(list_dot_product(embedding::double[], weights::double[]) + intercept))) END, 6) AS probability FROM patches, models"""))
def r6(spark, d):
    return rounded(R.score_many(patches(spark, d), models(spark, d)), "probability")


@query("R7_model_per_label")
def r7(spark, d):
    p = patches(spark, d).withColumns({"two": (F.col("label") == 2).cast("int"), "never": F.lit(0), "one": (F.col("label") == 1).cast("int")})
    fitted = R.fit_per_label(p, "embedding", ["two", "never", "one"])
    probabilities = R.score_many(p, spark.createDataFrame(fitted, R.MODEL_SCHEMA))
    return R.decide(probabilities, "one")


@query("R8_patch_classifier")
def r8(spark, d):
    """Patch-level model; patches keep their frame."""
    p = patches(spark, d)
    model = R.fit(p, "embedding")
    return p.select("frame_id", "patch_id", F.round(R.probability(F.col("embedding"), model), 4).alias("probability"))


@query("R9_normalised", with_views("patches", extra="""
x AS (SELECT patch_id, unnest(embedding)::double AS v, unnest(range(64)) AS i FROM patches),
s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1)""", body="""
SELECT patch_id, cast(i AS int) AS i, round((v - m) / s, 5) AS v FROM x JOIN s USING (i)"""))
def r9(spark, d):
    n = R.normalise(patches(spark, d))
    return n.select("patch_id", F.posexplode("normal").alias("i", "v")).withColumn("v", F.round("v", 5))


@query("R10_positive_weight", with_views("patches", body="""
SELECT 'patch' AS kind, round(count(*) FILTER (y = 0) / count(*) FILTER (y = 1), 8) AS pos_weight FROM patches
UNION ALL SELECT 'image', round(count(*) FILTER (y = 0) / count(*) FILTER (y = 1), 8) FROM (SELECT frame_id, max(y) AS y FROM patches GROUP BY 1)"""))
def r10(spark, d):
    p = patches(spark, d)
    a = R.positive_weight(p).withColumn("kind", F.lit("patch"))
    return rounded(a.unionByName(R.positive_weight(p, pooled_by="frame_id").withColumn("kind", F.lit("image"))), "pos_weight", places=8)


def stream_of(spark, df, label, slices=5, files=4, late=0, closing=False):
    """The rows as a file stream, one slice of the time axis per micro-batch, earlier slices first.

    Rows come up to ``late`` seconds after their time, so out of order; ``closing`` ends the stream with a closing row.
    """
    path = scratch_path(spark, label)
    df = cut_lineage(df, label + "-rows")  # read once for each slice
    came = F.col("ts").cast("double") + (F.pmod(F.xxhash64("event_id"), F.lit(late)) if late else F.lit(0))
    lo, hi = df.agg(F.min(came), F.max(came)).first()
    at = F.least(F.floor((came - lo) / ((hi - lo) / slices)), F.lit(slices - 1))
    for i in range(slices):
        df.where(at == i).repartition(files).write.mode("append").parquet(path)
    if closing:
        live.closing_row(df).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(df, spark, label):
    """Run a stream over what is there, into files, and return them as a table."""
    out, mark = scratch_path(spark, label), scratch_path(spark, label + "-mark")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def timed(spark, d):
    ts = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return det(spark, d).join(ts, "event_id")


@query("Z1_link_stream", recursive(with_views("det", extra=linker_sql("linked", K.SIMPLE, ["stream", "category"], source="(SELECT *, track_id % 2 AS stream FROM det)"), body="""
SELECT event_id, tid, suppressed FROM linked""")))
def z1(spark, d):
    """Boxes that come up to 50 minutes late, five frames, and in the order of a hash."""
    live.ordered_state(spark)
    boxes = timed(spark, d).withColumn("stream", F.col("track_id") % 2)
    source = stream_of(spark, boxes, "boxes", late=3000, closing=True)
    over = F.timestamp_seconds((F.col("frame_id") + 2840113) * 600)
    # A closing row has no frame; its time is far behind all others as it is.
    linked = live.link_stream(source, K.SIMPLE, F.coalesce(over, F.col("ts")), delay="1 hour", frame_seconds=600.0)
    return drain(linked, spark, "linked").select("event_id", "tid", "suppressed")


@query("Z2_live_chunk_stats", with_views("det", body="""
SELECT chunk_id, cast(sum(n) AS bigint) AS n_hits, count(*) FILTER (n = 1) AS n_once, count(*) AS n_unique FROM (
  SELECT chunk_id, track_id, count(*) AS n FROM det GROUP BY ALL) GROUP BY 1"""))
def z2(spark, d):
    source = stream_of(spark, timed(spark, d).select("ts", "event_id", "chunk_id", "track_id"), "log")
    out, mark = scratch_path(spark, "counts"), scratch_path(spark, "counts-mark")
    counts = live.count_stream(source)
    counts.writeStream.outputMode("update").option("checkpointLocation", mark).foreachBatch(
        lambda b, e: live.write_counts(b, e, out)).trigger(availableNow=True).start().awaitTermination()
    return live.current_chunk_stats(spark, out)


SESSIONS = """SELECT category, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS "end", count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY category ORDER BY ts) AS s FROM (
    SELECT event_type AS category, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 1800 SECOND THEN 0 ELSE 1 END AS new
    FROM events)) GROUP BY category, s"""


def positives(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def as_micros(s):
    return s.select("category", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@query("Z3_event_sessions", SESSIONS)
def z3(spark, d):
    return as_micros(live.event_sessions(positives(spark, d), "1800 seconds"))


@query("Z3_event_sessions_stream", SESSIONS)
def z3_stream(spark, d):
    """The same sessions of a stream whose rows come up to 50 minutes late; a closing row ends those still open."""
    source = stream_of(spark, positives(spark, d), "positives", late=3000, closing=True)
    return as_micros(drain(live.event_sessions(source, "1800 seconds", "1 hour"), spark, "sessions"))

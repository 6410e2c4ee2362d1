from pyspark.sql import functions as F

from framesift.functions import boxes as B
from framesift.functions.ordinal import seed_key
from framesift.operators import greedy, metrics, series, stats
from queries import views
from queries.q_detections import iou_sql, nms_sql, recursive
from queries.q_orders import plus_order
from queries.q_stats import rounded, slog
from queries.registry import query
from queries.views import CATEGORIES, det, excluded, frames, hits, patches, scores, table, with_views

views.define("smooth", """SELECT * FROM (SELECT a.category, a.frame_id, any_value(a.score) AS score,
    sum(b.score * exp(-0.5 * pow((b.frame_id - a.frame_id)/5.0::double, 2))) / sum(exp(-0.5 * pow((b.frame_id - a.frame_id)/5.0::double, 2))) AS smooth
  FROM scores a JOIN scores b ON b.category = a.category AND b.frame_id BETWEEN a.frame_id - 5 AND a.frame_id + 5 GROUP BY ALL)""", "scores")


@query("W1_smooth_scores", with_views("smooth", body="SELECT category, frame_id, round(smooth, 7) AS smooth FROM smooth"))
def w1(spark, d):
    return rounded(series.smooth_scores(scores(spark, d), 11, block=1000).select("category", "frame_id", "smooth"), "smooth", places=7)


def runs_sql(src, cond, part="category", period=None):
    start = "min(frame_id) OVER (PARTITION BY {p}, grp)".format(p=part)
    label = start if period is None else f"{start} + cast(floor((frame_id - {start})/{period}) AS bigint)*{period}"
    return f"""SELECT *, CASE WHEN on_ THEN {label} END AS run_start FROM (
  SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY {part} ORDER BY frame_id) * 2 + CASE WHEN on_ THEN 1 ELSE 0 END AS grp
  FROM (SELECT *, {cond} AS on_ FROM {src}))"""


@query("W2_label_runs", with_views("scores", body=f"SELECT category, frame_id, run_start FROM ({runs_sql('scores', 'score > 0.3')})"))
def w2(spark, d):
    return series.label_runs(scores(spark, d), F.col("score") > 0.3, ["category"], block=256).select("category", "frame_id", "run_start")


@query("W3_label_runs_limited", with_views("scores", body=f"SELECT category, frame_id, run_start FROM ({runs_sql('scores', 'score >= 0', period=25)})"))
def w3(spark, d):
    return series.label_runs(scores(spark, d), F.col("score") >= 0, ["category"], limit=24, block=256).select("category", "frame_id", "run_start")


@query("W4_score_instances", with_views("smooth", body=f"""
SELECT category, frame_id, CASE WHEN score > 0.2 THEN run_start END AS instance FROM ({runs_sql('smooth', 'smooth > 0.2')})"""))
def w4(spark, d):
    return series.score_instances(scores(spark, d), 11, 0.2, block=1000).select("category", "frame_id", "instance")


@query("W5_clip_timeline", """
SELECT o_orderkey, time_diff, round(time_diff - o_totalprice, 4) AS time_gap, round(time_diff/o_totalprice, 8) AS ratio, time_diff/o_totalprice > 1.1 AS missing_clip, time_diff - o_totalprice < 0 AS negative_gap
FROM (SELECT *, lead(t) OVER (PARTITION BY o_custkey ORDER BY t, o_orderkey) - t AS time_diff FROM (SELECT *, cast(epoch(o_orderdate) AS bigint) AS t FROM orders))""")
def w5(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
                                         F.col("o_totalprice").alias("duration"))
    t = series.clip_timeline(o, ["o_custkey"], "o_orderkey")
    return rounded(rounded(t.select("o_orderkey", "time_diff", "time_gap", "ratio", "missing_clip", "negative_gap"), "time_gap", places=4), "ratio", places=8)


@query("W7_every_skip", with_views("det", body="SELECT event_id, frame_id FROM det WHERE frame_id >= 100 AND (frame_id - 100) % 7 = 0"))
def w7(spark, d):
    return series.every(det(spark, d), 100, 7).select("event_id", "frame_id")


@query("W8_track_samples", with_views("det", body="""
SELECT event_id FROM (SELECT *, min(frame_id) OVER w AS a, max(frame_id) OVER w AS z FROM det WINDOW w AS (PARTITION BY category, track_id))
WHERE frame_id = z OR (frame_id - a) % greatest(cast(floor((z - a)/6) AS bigint), 1) = 0"""))
def w8(spark, d):
    return series.track_samples(det(spark, d), 6).select("event_id")


@query("J5_positional_join", "SELECT c_custkey AS i, c_name, o_orderdate FROM customer JOIN orders ON o_orderkey = c_custkey")
def j5(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), "c_name")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), "o_orderdate")
    return series.positional_join([c, o], "i")


@query("J6_frame_lookup", with_views("det", "scores", body="""
SELECT event_id, frame_id, category FROM det WHERE frame_id IN (SELECT frame_id FROM scores WHERE category = 'error' AND score > 0.8)"""))
def j6(spark, d):
    asked = scores(spark, d).where("category = 'error' AND score > 0.8")
    return series.lookup(det(spark, d), asked, "frame_id").select("event_id", "frame_id", "category")


@query("J8_locate_frames", """
SELECT l_orderkey AS frame_id, o_orderkey AS clip, l_orderkey - s AS local_frame FROM (
  SELECT o_orderkey, sum(n) OVER (ORDER BY o_orderkey) - n AS s, n FROM (SELECT o_orderkey, 1 + o_custkey % 3 AS n FROM orders))
JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey >= s AND l_orderkey < s + n""".replace("l_orderkey - s AS", "cast(l_orderkey - s AS bigint) AS"))
def j8(spark, d):
    clips = table(spark, d, "orders").select(F.col("o_orderkey").alias("clip"), (1 + F.col("o_custkey") % 3).alias("size"))
    asked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id")).distinct()
    return series.locate(asked, series.clip_starts(clips, "size", "clip"), "clip")


@query("J9_near_chunk_differences", with_views("det", body="""
SELECT a.chunk_id AS a, b.chunk_id AS b, a.t - b.t AS dt FROM (SELECT chunk_id, min(frame_id) * 600 AS t FROM det GROUP BY 1) a
JOIN (SELECT chunk_id, min(frame_id) * 600 AS t FROM det GROUP BY 1) b ON abs(a.t - b.t) <= 27.5::double * 7200"""))
def j9(spark, d):
    c = det(spark, d).groupBy("chunk_id").agg((F.min("frame_id") * 600).alias("t"))
    return series.near_chunk_differences(c, "t", 7200.0)


@query("J10_key_pairs", with_views("det", body="""
SELECT event_id FROM det WHERE (category, track_id) IN (SELECT category, track_id FROM det WHERE confidence > 0.8)"""))
def j10(spark, d):
    x = det(spark, d)
    return series.in_pairs(x, x.where("confidence > 0.8"), ["category", "track_id"]).select("event_id")


@query("B11_smoothed_hit_rate", with_views("slog", extra="""
c AS (SELECT experiment, chunk_id, count(*) AS n, count(*) FILTER (k > 0) AS h FROM (SELECT experiment, chunk_id, frame_id, count(track_id) AS k FROM slog GROUP BY ALL) GROUP BY ALL)""", body="""
SELECT a.experiment, a.chunk_id, round(sum(exp(-pow((a.chunk_id - b.chunk_id)*86400/50000.0::double, 2)) * b.h) / sum(exp(-pow((a.chunk_id - b.chunk_id)*86400/50000.0::double, 2)) * b.n), 8) AS rate
FROM c a JOIN c b ON a.experiment = b.experiment GROUP BY ALL"""))
def b11(spark, d):
    c = stats.chunk_counters(slog(spark, d), ["experiment"]).withColumn("t", F.col("chunk_id") * 86400)
    return rounded(series.smoothed_hit_rate(c, "t", 50000.0, ["experiment"]), "rate", places=8)


@query("U1_union_results", with_views("det", "hits", body="""
SELECT frame_id, category, confidence, cast(NULL AS bigint) AS track_id FROM det
UNION ALL SELECT frame_id, category, NULL, track_id FROM hits"""))
def u1(spark, d):
    x = det(spark, d)
    return x.select("frame_id", "category", "confidence").unionByName(hits(spark, d), allowMissingColumns=True)


@query("U2_set_algebra", with_views("hits", body="""
SELECT 'union' AS kind, count(*) AS n FROM (SELECT track_id FROM hits WHERE category='click' UNION SELECT track_id FROM hits WHERE category='view')
UNION ALL SELECT 'intersection', count(*) FROM (SELECT frame_id FROM hits WHERE category='click' INTERSECT SELECT frame_id FROM hits WHERE category='view')
UNION ALL SELECT 'difference', count(*) FROM (SELECT frame_id FROM hits WHERE category='click' EXCEPT SELECT frame_id FROM hits WHERE category='view')
UNION ALL SELECT 'not contained', count(*) FROM (SELECT frame_id FROM hits WHERE category='click' EXCEPT SELECT frame_id FROM frames WHERE split='test')""".replace(
    "FROM frames WHERE split='test'", "FROM usable")))
def u2(spark, d):
    h = hits(spark, d)
    ids = lambda c, k: h.where(F.col("category") == c).select(k)
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    a, b = ids("click", "frame_id"), ids("view", "frame_id")
    parts = [count(ids("click", "track_id").union(ids("view", "track_id")).distinct(), "union"), count(a.intersect(b), "intersection"),
             count(a.subtract(b), "difference"), count(a.subtract(views.usable(spark, d).select("frame_id")), "not contained")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@query("U3_first_of_duplicates", """
SELECT l_suppkey, arg_min(l_partkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_partkey FROM lineitem GROUP BY ALL""")
def u3(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_suppkey").agg(F.min_by("l_partkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("l_partkey"))


# Ranking metrics: truth = frame has a wide usable box of the class, score = best confidence rounded so that ties occur.
views.define("ranked", """SELECT s.category, s.frame_id, round(s.score, 2) AS score, cast(t.frame_id IS NOT NULL AS int) AS y FROM scores s
  LEFT JOIN (SELECT DISTINCT category, frame_id FROM usable WHERE xmax - xmin > 80) t ON t.category = s.category AND t.frame_id = s.frame_id""", "scores", "usable")


def ranked(spark, d):
    t = views.usable(spark, d).where("xmax - xmin > 80").select("category", "frame_id").distinct().withColumn("y", F.lit(1))
    return scores(spark, d).withColumn("score", F.round("score", 2)).join(t, ["category", "frame_id"], "left").fillna(0, ["y"])


@query("M1_precision_in_top", with_views("ranked", body="""
SELECT round(sum(y)/100, 8) AS precision FROM (SELECT y FROM ranked WHERE category = 'view' ORDER BY score DESC, frame_id LIMIT 100)"""))
def m1(spark, d):
    return rounded(metrics.precision_in_top(ranked(spark, d).where("category = 'view'"), "y", "score", 100, "frame_id"), "precision", places=8)


AP = """(SELECT {k}, score, sum(y) AS pos, sum(sum(y)) OVER w AS cp, sum(count(*)) OVER w AS cn FROM {src} GROUP BY {k}, score WINDOW w AS (PARTITION BY {k} ORDER BY score DESC))"""


@query("M2_average_precision", with_views("ranked", body=f"""
SELECT category, round(sum(pos * cp / cn) / sum(pos), 8) AS average_precision FROM {AP.format(k='category', src='ranked')} GROUP BY 1"""))
def m2(spark, d):
    return rounded(metrics.average_precision(ranked(spark, d), "y", "score", ["category"]), "average_precision", places=8)


@query("M2_precision_over_random", with_views("ranked", body=f"""
SELECT a.category, round(a.ap, 6) AS ap, round(b.ap, 6) AS random_ap, round(a.ap/b.ap, 6) AS ratio FROM
 (SELECT category, sum(pos * cp / cn) / sum(pos) AS ap FROM {AP.format(k='category', src='ranked')} GROUP BY 1) a JOIN
 (SELECT category, sum(pos * cp / cn) / sum(pos) AS ap FROM {AP.format(k='category', src="(SELECT category, y, md5('1:' || frame_id) AS score FROM ranked)")} GROUP BY 1) b ON a.category = b.category"""))
def m2_random(spark, d):
    r = ranked(spark, d)
    a = metrics.average_precision(r, "y", "score", ["category"]).withColumnRenamed("average_precision", "ap")
    # A random score as a number: the order of the hex key as a double keeps its first 13 digits.
    shuffled = r.withColumn("score", F.conv(F.substring(seed_key(1, "frame_id"), 1, 13), 16, 10).cast("double"))
    b = metrics.average_precision(shuffled, "y", "score", ["category"]).withColumnRenamed("average_precision", "random_ap")
    return rounded(a.join(b, "category").withColumn("ratio", F.col("ap") / F.col("random_ap")), "ap", "random_ap", "ratio")


def dcg_sql(score, name):
    return f"""{name} AS (SELECT category, sum(g / n * list_sum(list_transform(range(cast(lo AS bigint), cast(least(cn, 200) AS bigint)), lambda r: 1/log2(r + 2.0::double)))) AS v FROM (
  SELECT *, cn - n AS lo FROM (SELECT category, {score} AS s, sum(y)::double AS g, count(*) AS n, sum(count(*)) OVER (PARTITION BY category ORDER BY {score} DESC) AS cn FROM ranked GROUP BY category, {score})) WHERE lo < 200 GROUP BY 1)"""


@query("M3_ndcg", with_views("ranked", extra=dcg_sql("score", "a") + ", " + dcg_sql("y", "b"), body="""
SELECT a.category, round(a.v / b.v, 8) AS ndcg FROM a JOIN b ON a.category = b.category"""))
def m3(spark, d):
    return rounded(metrics.ndcg(ranked(spark, d), "y", "score", 200, ["category"]), "ndcg", places=8)


@query("M4_pooled_precision", with_views("patches", extra="""
p AS (SELECT 1 AS one, frame_id, max(y) AS y, max(round(embedding[1]::double, 2)) AS score FROM patches GROUP BY 2)""", body=f"""
SELECT round(sum(pos * cp / cn) / sum(pos), 8) AS average_precision FROM {AP.format(k='one', src='p')}"""))
def m4(spark, d):
    p = patches(spark, d).withColumn("score", F.round(F.col("embedding")[0].cast("double"), 2))
    return rounded(metrics.average_precision(metrics.pooled(p, "frame_id", "y", "score"), "y", "score"), "average_precision", places=8)


views.define("preds", "SELECT * FROM det WHERE category IN ('view', 'error')", "det")
views.define("truths", "SELECT * FROM det WHERE category = 'click'", "det")
MATCH = f"""pb AS (SELECT a.event_id, max({iou_sql()}) AS best FROM {{p}} a JOIN truths b ON a.frame_id = b.frame_id GROUP BY 1),
tb AS (SELECT b.event_id, max({iou_sql()}) AS best, max(CASE WHEN {iou_sql()} > 0.05 THEN a.confidence ELSE 0 END) AS sc FROM {{p}} a JOIN truths b ON a.frame_id = b.frame_id GROUP BY 1),
out AS (SELECT p.*, coalesce(best > 0.05, false) AS matched FROM {{p}} p LEFT JOIN pb ON pb.event_id = p.event_id),
tgt AS (SELECT t.*, coalesce(sc, 0) AS target_score, coalesce(best > 0.05, false) AS found FROM truths t LEFT JOIN tb ON tb.event_id = t.event_id)"""


def matches(spark, d):
    x = det(spark, d)
    return metrics.match_summary(x.where("category IN ('view', 'error')"), x.where("category = 'click'"), ["frame_id"], "event_id", "event_id", "confidence", 0.05)


@query("M5_match_summary", with_views("preds", "truths", extra=MATCH.format(p="preds"), body="""
SELECT event_id, 'predicted' AS side, matched AS hit, round(confidence, 8) AS score FROM out
UNION ALL SELECT event_id, 'truth', found, round(target_score, 8) FROM tgt"""))
def m5(spark, d):
    out, tgt = matches(spark, d)
    a = out.select("event_id", F.lit("predicted").alias("side"), F.col("matched").alias("hit"), F.col("confidence").alias("score"))
    b = tgt.select("event_id", F.lit("truth").alias("side"), F.col("found").alias("hit"), F.col("target_score").alias("score"))
    return rounded(a.unionByName(b), "score", places=8)


@query("M6_precision_at_recall", with_views("preds", "truths", extra=MATCH.format(p="preds") + """,
s AS (SELECT list_sort(list(target_score)) AS l, count(*) AS n FROM tgt),
cuts AS (SELECT level, l[cast(floor((1 - level) * (n - 1)) AS int) + 1] AS cutoff FROM s, (SELECT unnest([0.02::double, 0.05, 0.5]) AS level))""", body="""
SELECT level, round(cutoff, 8) AS cutoff, round((SELECT count(*) FILTER (matched) / count(*) FROM out WHERE confidence > cutoff), 8) AS precision,
  round((SELECT count(*) FILTER (target_score > cutoff) / count(*) FROM tgt), 8) AS recall FROM cuts"""))
def m6(spark, d):
    out, tgt = matches(spark, d)
    return rounded(metrics.precision_at_recall(out, tgt, "confidence", [.02, .05, .5]), "cutoff", "precision", "recall", places=8)


@query("M7_box_metrics", recursive(with_views("preds", "truths", extra="passed AS (SELECT * FROM preds WHERE confidence > 0.1), "
       + nms_sql("passed", ["frame_id"], "confidence", 0.1) + ", keptb AS (SELECT * FROM verdict WHERE kept), " + MATCH.format(p="keptb"), body="""
SELECT frame_id, max_score, coalesce(tp, 0) AS total_proposals, coalesce(mp, 0) AS matched_proposals, coalesce(tt, 0) AS total_true, coalesce(mt, 0) AS matched_true FROM
  (SELECT frame_id, round(max(confidence), 8) AS max_score FROM preds GROUP BY 1)
  FULL JOIN (SELECT frame_id, count(*) AS tp, count(*) FILTER (matched) AS mp FROM out GROUP BY 1) USING (frame_id)
  FULL JOIN (SELECT frame_id, count(*) AS tt, count(*) FILTER (found) AS mt FROM tgt GROUP BY 1) USING (frame_id)""")))
def m7(spark, d):
    x = det(spark, d)
    m = metrics.box_metrics(x.where("category IN ('view', 'error')"), x.where("category = 'click'"), "frame_id", "event_id", "event_id",
                            "confidence", 0.1, 0.1, 0.05)
    return rounded(m, "max_score", places=8)


def spaced_sql(distance):
    src, parts, level, d = "base", [], 0, distance
    base = "base AS (SELECT frame_id, row_number() OVER (ORDER BY score DESC, md5('0:' || frame_id), frame_id) - 1 AS rk FROM scores WHERE category = 'view' AND frame_id % 10 > 1)"
    picks = []
    while True:
        if d == 0:
            picks.append(f"SELECT frame_id, rk, {level} AS level FROM {src}")
            break
        parts.append(f"""w{level} AS (SELECT 0 AS it, frame_id, rk, 0 AS st FROM {src}
  UNION ALL SELECT it + 1, frame_id, rk, CASE WHEN st <> 0 THEN st WHEN bt < rk THEN 2 WHEN bo >= rk THEN 1 ELSE 0 END FROM (
    SELECT *, min(CASE WHEN st = 1 THEN rk END) OVER w AS bt, min(CASE WHEN st <> 2 THEN rk END) OVER w AS bo, sum(CASE WHEN st = 0 THEN 1 ELSE 0 END) OVER () AS n_open
    FROM w{level} WINDOW w AS (ORDER BY frame_id RANGE BETWEEN {d - 1} PRECEDING AND {d} FOLLOWING)) WHERE n_open > 0),
f{level} AS (SELECT * FROM w{level} WHERE it = (SELECT max(it) FROM w{level})),
s{level} AS (SELECT frame_id, rk FROM f{level} WHERE st = 2)""")
        picks.append(f"SELECT frame_id, rk, {level} AS level FROM f{level} WHERE st = 1")
        src, level, d = f"s{level}", level + 1, d // 2
    return recursive(with_views("scores", extra=base + ", " + ", ".join(parts), body=f"""
SELECT frame_id, level, row_number() OVER (ORDER BY level, rk) - 1 AS pos FROM ({' UNION ALL '.join(picks)})"""))


@query("O6_spaced_score_order", spaced_sql(8))
def o6(spark, d):
    s = scores(spark, d).where("category = 'view'")
    return greedy.spaced_score_order(s, excluded(spark, d), distance=8, block=1024).select("frame_id", "level", "pos")


@query("O7_gap_order")
def o7(spark, d):
    s = scores(spark, d).where("category = 'view'").withColumn("score", F.round("score", 1))
    p = hits(spark, d).where("category = 'view'").select("frame_id")
    return greedy.gap_order(s, p, gap=3, block=1024).select("frame_id", "pass", "pos")


GAP = 12
EVENTS = f"""q AS (SELECT category, frame_id, pos, row_number() OVER (PARTITION BY category ORDER BY pos) AS k FROM (
  SELECT category, frame_id FROM usable GROUP BY ALL HAVING count(*) >= 2) JOIN plus_order USING (frame_id)),
walk AS (SELECT category, 1::bigint AS k, [frame_id] AS acc FROM q WHERE k = 1
  UNION ALL SELECT w.category, q.k, CASE WHEN len(list_filter(w.acc, lambda a: abs(a - q.frame_id) <= {GAP})) > 0 THEN w.acc ELSE list_append(w.acc, q.frame_id) END
  FROM walk w JOIN q ON q.category = w.category AND q.k = w.k + 1),
events_ AS (SELECT q.category, q.frame_id AS event_id, q.pos FROM q JOIN (SELECT category, arg_max(acc, k) AS acc FROM walk GROUP BY 1) w ON w.category = q.category AND list_contains(w.acc, q.frame_id))"""


def graded_events(spark, d):
    return greedy.grade_events(plus_order(spark, d), views.usable(spark, d), 2, GAP, block=1024)


@query("Q4_events", recursive(with_views("usable", "plus_order", extra=EVENTS, body="SELECT * FROM events_")))
def q4(spark, d):
    return graded_events(spark, d)[0]


@query("Q4_event_repeats", recursive(with_views("usable", "plus_order", extra=EVENTS, body=f"""
SELECT e.category, o.frame_id, o.pos, e.event_id FROM events_ e JOIN plus_order o ON abs(o.frame_id - e.event_id) <= {GAP} AND o.pos > e.pos""")))
def q4_repeats(spark, d):
    return graded_events(spark, d)[1]


@query("Q4_event_history", recursive(with_views("usable", "plus_order", extra=EVENTS, body="""
SELECT category, pos + 1 AS nf, row_number() OVER (PARTITION BY category ORDER BY pos) AS ni FROM events_
UNION ALL SELECT category, 0, 0 FROM events_ GROUP BY 1 UNION ALL SELECT category, (SELECT count(*) FROM plus_order), count(*) FROM events_ GROUP BY 1""")))
def q4_history(spark, d):
    return greedy.event_history(graded_events(spark, d)[0], plus_order(spark, d).count())

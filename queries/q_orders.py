from pyspark.sql import functions as F

from framesift.operators import orders, prep
from framesift.plans import curves
from queries import views
from queries.registry import query
from queries.views import (CATEGORIES, det, det_big, excluded, frames, frames_big, hits, patches, scores,
                           table, usable, video_len, with_views)

OFFSET = 37
#: Any axis of at least this many frames has the same levels, which start at every 256th frame.
AXIS = 1024


def level_sql(frame: str, size: int, offset: int = OFFSET) -> str:
    cases = " ".join(f"WHEN {frame} % {s} = {o} THEN {k}" for k, (s, o) in enumerate(orders.stride_levels(size, 256, offset)))
    return f"CASE {cases} END"


def open_frames(spark, d):
    return prep.remove_frames(frames(spark, d).select("frame_id"), excluded(spark, d))


views.define("open_frames", "SELECT frame_id FROM frames WHERE split = 'test'", "frames")
views.define("plus_order", f"""SELECT frame_id, row_number() OVER (ORDER BY {level_sql('frame_id', AXIS)}, md5('5:' || frame_id)) - 1 AS pos
  FROM open_frames""", "open_frames")


def plus_order(spark, d):
    return orders.stride_halving_order(open_frames(spark, d), AXIS, seed=5, initial_offset=OFFSET)


@query("O1_random_order", with_views("open_frames", body="""
SELECT frame_id, row_number() OVER (ORDER BY md5('3:' || frame_id)) - 1 AS pos FROM open_frames"""))
def o1(spark, d):
    return orders.random_order(open_frames(spark, d), 3)


@query("O1_random_order_large", """
SELECT o_orderkey AS frame_id, row_number() OVER (ORDER BY md5('3:' || o_orderkey)) - 1 AS pos FROM orders""")
def o1_large(spark, d):
    return orders.random_order(frames_big(spark, d), 3)


@query("O2_random_draw", """
SELECT frame_id, pos FROM (SELECT o_orderkey AS frame_id, row_number() OVER (ORDER BY md5('11:' || o_orderkey)) - 1 AS pos FROM orders)
WHERE pos BETWEEN 200 AND 299""")
def o2(spark, d):
    return orders.random_draw(frames_big(spark, d), 11, batch=100, step=2)


@query("O3_stride_halving_order", with_views("plus_order", body=f"""
SELECT frame_id, {level_sql('frame_id', AXIS)} AS level, pos FROM plus_order"""))
def o3(spark, d):
    return plus_order(spark, d)


@query("O3_stride_halving_scored", with_views("scores", body=f"""
SELECT frame_id, {level_sql('frame_id', AXIS)} AS level,
  row_number() OVER (ORDER BY {level_sql('frame_id', AXIS)}, score DESC, md5('5:' || frame_id)) - 1 AS pos
FROM scores WHERE category = 'view'"""))
def o3_scored(spark, d):
    s = scores(spark, d).where(F.col("category") == "view")
    return orders.stride_halving_order(s, AXIS, seed=5, score="score", initial_offset=OFFSET)


@query("O4_order_batches", with_views("plus_order", "det", body="""
SELECT frame_id, pos FROM (
  SELECT frame_id, row_number() OVER (ORDER BY pos) - 1 AS pos FROM plus_order
  WHERE frame_id NOT IN (SELECT frame_id FROM det WHERE category = 'error')) WHERE pos BETWEEN 50 AND 149"""))
def o4(spark, d):
    busy = det(spark, d).where(F.col("category") == "error").select("frame_id")
    return orders.next_batch(plus_order(spark, d), 50, 100, excluded=busy).select("frame_id", "pos")


@query("O5_rank_scores", with_views("det", body="""
SELECT draw, chunk_id, row_number() OVER (PARTITION BY draw ORDER BY score DESC, md5('9:' || draw || ':' || chunk_id)) - 1 AS rank
FROM (SELECT draw, chunk_id, score FROM (SELECT chunk_id, floor(count(*)/50) AS score FROM det GROUP BY 1),
      (SELECT unnest(range(6)) AS draw))"""))
def o5(spark, d):
    s = det(spark, d).groupBy("chunk_id").agg(F.floor(F.count(F.lit(1)) / 50).alias("score"))
    draws = s.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    return orders.rank_scores(draws, ["draw"], "score", 9, ["chunk_id"]).select("draw", "chunk_id", "rank")


@query("O8_bit_reversed_order", """
SELECT event_id, row_number() OVER (ORDER BY reverse(lpad(bin(epoch_us(ts) * 1000), 64, '0')), event_id) - 1 AS pos FROM events""")
def o8(spark, d):
    e = table(spark, d, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return orders.bit_reversed_order(e, ns, "event_id").select("event_id", "pos")


@query("O9_skip_order", """
SELECT cast(floor((epoch(ts) + 1234)/3600) AS bigint) AS bucket, arg_min(event_id, (ts, event_id)) AS frame_id FROM events GROUP BY 1""")
def o9(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("frame_id"), F.col("ts").cast("timestamp").alias("ts"))
    return orders.skip_order(e, F.unix_micros("ts") / 1000000, 3600, 1234)


@query("O10_chunk_queues", with_views("plus_order", "frames", body="""
SELECT f.frame_id, f.chunk_id, row_number() OVER (PARTITION BY f.chunk_id ORDER BY o.pos) - 1 AS pos
FROM plus_order o JOIN frames f ON f.frame_id = o.frame_id"""))
def o10(spark, d):
    return orders.chunk_queues(plus_order(spark, d), frames(spark, d)).select("frame_id", "chunk_id", "pos")


@query("O11_frame_score_order", with_views("hits", body="""
SELECT frame_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, md5('0:' || frame_id)) - 1 AS pos
FROM (SELECT frame_id, cast(sum(track_id % 17) AS double) AS score FROM hits GROUP BY 1)"""))
def o11(spark, d):
    h = hits(spark, d)
    tracks = h.select("track_id").distinct().withColumn("w", (F.col("track_id") % 17).cast("double"))
    summed = orders.frame_score_sums(h, tracks, "w")
    return orders.score_order(summed, "score").select("frame_id", F.round("score", 6).alias("score"), "pos")


@query("O12_top_unseen", with_views("scores", body="""
SELECT frame_id, round(score, 6) AS score FROM scores WHERE category = 'click' AND frame_id % 10 > 1
ORDER BY scores.score DESC, frame_id LIMIT 50"""))
def o12(spark, d):
    s = scores(spark, d).where(F.col("category") == "click")
    return orders.top_unseen(s, excluded(spark, d), 50).select("frame_id", F.round("score", 6).alias("score"))


@query("O13_sampled_negatives", with_views("patches", extra="""
ranked AS (SELECT patch_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('4:' || patch_id)) - 1 AS p FROM patches),
neg AS (SELECT * FROM ranked WHERE y = 0),
slots AS (SELECT unnest(range(2 * p, 2 * p + 2)) AS slot FROM ranked WHERE y = 1)""", body="""
SELECT patch_id, y, cast(NULL AS bigint) AS slot FROM ranked WHERE y = 1
UNION ALL SELECT n.patch_id, n.y, s.slot FROM slots s JOIN neg n
  ON n.p = ('0x' || substr(md5('4:slot:' || s.slot), 1, 8))::bigint % (SELECT count(*) FROM neg)"""))
def o13(spark, d):
    return orders.sampled_negatives(patches(spark, d).select("patch_id", "y"), "patch_id", "y", 4)


@query("O14_multi_key_sort", with_views("usable", body="""
SELECT event_id, row_number() OVER (ORDER BY category, frame_id, track_id, event_id) - 1 AS pos FROM usable"""))
def o14(spark, d):
    from framesift.functions.ordinal import positions
    keys = [F.col(c) for c in ("category", "frame_id", "track_id", "event_id")]
    return positions(usable(spark, d), keys).select("event_id", "pos")


@query("O15_weighted_order", with_views("scores", extra="""
u AS (SELECT frame_id, ln((score + 0.01)/(1.01 - score)) AS logit,
  ((('0x' || substr(md5('8:' || frame_id), 1, 13))::bigint)::double + 0.5) / 4503599627370496 AS u FROM scores WHERE category = 'view')""", body="""
SELECT t, frame_id, row_number() OVER (PARTITION BY t ORDER BY ln(-ln(u)) - logit/t, frame_id) - 1 AS pos
FROM u, (SELECT unnest([0.1::double, 1, 10]) AS t)"""))
def o15(spark, d):
    s = scores(spark, d).where(F.col("category") == "view").withColumn(
        "logit", F.log((F.col("score") + 0.01) / (F.lit(1.01) - F.col("score"))))
    return orders.weighted_order(s, "logit", [0.1, 1.0, 10.0], 8)


CURVE = """
SELECT category, pos + 1 AS nf, cast(sum(new) OVER (PARTITION BY category ORDER BY pos) AS bigint) AS ni
FROM (SELECT category, pos, count(*) AS new FROM (
  SELECT h.category, h.track_id, min(o.pos) AS pos FROM hits h JOIN plus_order o ON o.frame_id = h.frame_id GROUP BY ALL) GROUP BY ALL)"""


@query("Q7_discovery_curve", with_views("hits", "plus_order", body=CURVE))
def q7(spark, d):
    return curves.discovery_curve(plus_order(spark, d), hits(spark, d), length=video_len(spark, d))


@query("Q7_discovery_curve_large", with_views("det_big", extra="""
plus_order AS (SELECT o_orderkey AS frame_id, row_number() OVER (ORDER BY """ + level_sql("o_orderkey", 1 << 20) + """, md5('5:' || o_orderkey)) - 1 AS pos FROM orders),
hits AS (SELECT DISTINCT * FROM det_big)""", body=CURVE))
def q7_large(spark, d):
    order = orders.stride_halving_order(frames_big(spark, d), 1 << 20, seed=5, initial_offset=OFFSET)
    return curves.discovery_curve(order, det_big(spark, d))


N_OPEN = "(SELECT count(*) FROM open_frames)"
views.define("graded", f"""
  SELECT category, s.ni AS ni, s.nf AS nf, s.seq AS seq FROM (
    SELECT category, unnest([{{'ni': ni - new, 'nf': b*10, 'seq': 2*b+1}}, {{'ni': ni, 'nf': least((b+1)*10, {N_OPEN}), 'seq': 2*b+2}}]) AS s
    FROM (SELECT category, b, new, cast(sum(new) OVER (PARTITION BY category ORDER BY b) AS bigint) AS ni FROM (
      SELECT category, cast(floor(pos/10) AS bigint) AS b, count(*) AS new FROM (
        SELECT h.category, h.track_id, min(o.pos) AS pos FROM hits h JOIN plus_order o ON o.frame_id = h.frame_id GROUP BY ALL) GROUP BY ALL)))
  UNION ALL SELECT category, 0, 0, 0 FROM hits GROUP BY 1
  UNION ALL SELECT category, count(DISTINCT track_id), {N_OPEN}, cast(2 * ceil({N_OPEN} / 10) + 1 AS bigint) FROM hits GROUP BY 1""", "hits", "plus_order")


@query("Q3_graded_history", with_views("graded", body="""
SELECT category, cast(ni AS bigint) AS ni, cast(nf AS bigint) AS nf, cast(seq AS bigint) AS seq FROM graded"""))
def q3(spark, d):
    return curves.graded_history(plus_order(spark, d), hits(spark, d), 10, open_frames(spark, d).count())


@query("Q3_bad_frames", """
SELECT l_orderkey AS frame_id, 'repeated' AS why FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT l_orderkey, 'excluded' FROM lineitem WHERE l_linenumber = 1 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def q3_bad(spark, d):
    order = table(spark, d, "lineitem").where(F.col("l_linenumber") == 1).select(F.col("l_orderkey").alias("frame_id"))
    bad = table(spark, d, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("frame_id"))
    return curves.reject_bad_order(order, bad)


@query("Q6_result_table", with_views("graded", "hits", "open_frames", extra="""
tot AS (SELECT category, count(DISTINCT track_id) AS total_ni, (SELECT count(*) FROM open_frames) AS total_nf FROM hits GROUP BY 1),
flat AS (SELECT category, ni, unnest([min(nf), max(nf)]) AS nf FROM graded GROUP BY category, ni)""", body="""
SELECT f.category, cast(f.ni AS bigint) AS ni, cast(f.nf AS bigint) AS nf, total_ni, total_nf,
  round(f.ni/total_ni, 6) AS instance_f, round(f.nf/total_nf, 6) AS frame_f
FROM flat f JOIN tot t ON t.category = f.category"""))
def q6(spark, d):
    h = curves.graded_history(plus_order(spark, d), hits(spark, d), 10, open_frames(spark, d).count())
    totals = prep.category_totals(usable(spark, d), frames(spark, d), excluded(spark, d))
    out = curves.result_table(h, totals, ["category"])
    return out.withColumn("instance_f", F.round("instance_f", 6)).withColumn("frame_f", F.round("frame_f", 6))


@query("W6_running_distinct", with_views("det", body="""
SELECT chunk_id, cast(sum(new) OVER (ORDER BY chunk_id) AS bigint) AS distinct_tracks FROM (
  SELECT f AS chunk_id, count(*) AS new FROM (SELECT track_id, category, min(chunk_id) AS f FROM det GROUP BY ALL) GROUP BY 1)"""))
def w6(spark, d):
    from framesift.functions.ordinal import running
    first = det(spark, d).groupBy("track_id", "category").agg(F.min("chunk_id").alias("chunk_id"))
    news = first.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("new"))
    return running(news, [F.col("chunk_id")], F.floor(F.col("chunk_id") / 8), value=F.col("new"), name="distinct_tracks").drop("new")

from pyspark.sql import functions as F

from framesift.functions.ordinal import running, sampled_bucket
from framesift.operators import orders, prep
from framesift.plans import curves
from framesift.plans import evaluate as ev
from framesift.session import cut_lineage
from queries import views
from queries.q_orders import open_frames
from queries.q_stats import rounded
from queries.registry import query
from queries.q_orders import AXIS
from queries.views import excluded, frames, hits, usable, video_len, with_views

SEEDS = 5
LEVEL = "CASE " + " ".join(f"WHEN frame_id % {s} = (seed * 37) % {s} THEN {k}" for k, (s, _) in enumerate(orders.stride_levels(AXIS))) + " END"
views.define("runs", f"""SELECT 'det' AS dataset, category AS object_class, method, method || '-' || seed AS experiment_id, nf,
    cast(sum(new) OVER (PARTITION BY category, method, seed ORDER BY nf) AS bigint) AS ni, total_ni, (SELECT count(*) FROM open_frames) AS total_nf
  FROM (SELECT category, method, seed, pos + 1 AS nf, count(*) AS new FROM (
    SELECT h.category, h.track_id, o.method, o.seed, min(o.pos) AS pos FROM hits h JOIN (
      SELECT method, seed, frame_id, row_number() OVER (PARTITION BY method, seed ORDER BY lvl, key) - 1 AS pos FROM (
        SELECT 'random' AS method, seed, frame_id, 0::bigint AS lvl, md5('r' || seed || ':' || frame_id) AS key FROM open_frames, seeds
        UNION ALL SELECT 'random+', seed, frame_id, {LEVEL}, md5('p' || seed || ':' || frame_id) FROM open_frames, seeds
        UNION ALL SELECT 'scored', seed, frame_id, -coalesce(n, 0), md5('s' || seed || ':' || frame_id) FROM open_frames
          LEFT JOIN (SELECT frame_id, count(*) AS n FROM hits GROUP BY 1) USING (frame_id), seeds)) o ON o.frame_id = h.frame_id GROUP BY ALL) GROUP BY ALL)
  JOIN (SELECT category, count(DISTINCT track_id) AS total_ni FROM hits GROUP BY 1) USING (category)""", "hits", "open_frames", "seeds")
views.define("seeds", f"SELECT unnest(range({SEEDS})) AS seed")
_memo = {}


def runs(spark, d):
    """Histories of 3 orders × 5 seeds × all categories, written once per session like a result dump."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _memo:
        _memo[key] = cut_lineage(_runs(spark, d), "runs")
    return _memo[key]


def _runs(spark, d):
    h = hits(spark, d)
    seeded = open_frames(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))))
    n = h.groupBy("frame_id").agg((-F.count(F.lit(1))).alias("neg"))
    levels = orders.stride_levels(AXIS)
    level = F.coalesce(*[F.when(F.col("frame_id") % s == (F.col("seed") * 37) % s, F.lit(k)) for k, (s, _) in enumerate(levels)])
    key = lambda m: F.md5(F.concat(F.lit(m), F.col("seed").cast("string"), F.lit(":"), F.col("frame_id").cast("string")))
    part = lambda df, m, lvl, k: df.select(F.lit(m).alias("method"), "seed", "frame_id", lvl.cast("long").alias("lvl"), key(k).alias("key"))
    rows = part(seeded, "random", F.lit(0), "r").unionByName(part(seeded, "random+", level, "p")).unionByName(
        part(seeded.join(n, "frame_id", "left").fillna(0, ["neg"]), "scored", F.col("neg"), "s"))
    order_by = [F.col("lvl"), F.col("key")]
    order = running(rows, order_by, sampled_bucket(rows, order_by), by=["method", "seed"]).select("method", "seed", "frame_id", "pos")
    curve = curves.discovery_curve(order, h, by=["method", "seed"], length=video_len(spark, d))
    totals = prep.category_totals(usable(spark, d), frames(spark, d), excluded(spark, d))
    return curve.join(totals, "category").select(
        F.lit("det").alias("dataset"), F.col("category").alias("object_class"), "method",
        F.concat_ws("-", "method", F.col("seed").cast("string")).alias("experiment_id"), "nf", "ni", "total_ni", "total_nf")


@query("Q10_replicated_runs", with_views("runs", body="SELECT * FROM runs"))
def q10(spark, d):
    return runs(spark, d)


def savings_sql(fixed, measured, levels, qs, relative=False, ref="random", inverse=False):
    lv = ", ".join(f"{float(x)}::double" for x in levels)
    level = f"round_even(l * {'total_ni' if fixed == 'ni' else 'total_nf'}, 0)" if relative else "l"
    ratio = "(metric+1)/(ref+1)" if inverse else "(ref+1)/(metric+1)"
    return f"""
SELECT object_class, method, l AS rel_level, level, round(lower, 6) AS lower, round(metric, 6) AS metric, round("upper", 6) AS "upper", round(ref, 6) AS ref, round({ratio}, 6) AS ratio FROM (
  SELECT *, max(CASE WHEN method = '{ref}' THEN metric END) OVER (PARTITION BY object_class, l, level) AS ref FROM (
    SELECT object_class, method, l, level, quantile_cont(m, {qs[0]}) AS lower, quantile_cont(m, {qs[1]}) AS metric, quantile_cont(m, {qs[2]}) AS "upper" FROM (
      SELECT object_class, method, experiment_id, l, level, min({measured}) AS m FROM (
        SELECT *, {level}::double AS level FROM runs, (SELECT unnest([{lv}]) AS l)) WHERE {fixed} >= level GROUP BY ALL) GROUP BY ALL))"""


def q_savings(spark, d, fixed, levels, measured, qs, **kw):
    rows = ev.savings_at(runs(spark, d), ["object_class"], "method", fixed, levels, measured, qs, **kw)
    return rounded(rows, "lower", "metric", "upper", "ref", "ratio")


@query("V1_savings_at_level", with_views("runs", body=savings_sql("ni", "nf", [50], (.1, .5, .9))))
def v1(spark, d):
    return q_savings(spark, d, "ni", [50], "nf", (.1, .5, .9))


@query("V2_savings_at_fraction", with_views("runs", body=savings_sql("ni", "nf", [.5], (.25, .5, .75), relative=True)))
def v2(spark, d):
    return q_savings(spark, d, "ni", [.5], "nf", (.25, .5, .75), relative=True)


@query("V2_finds_at_frames", with_views("runs", body=savings_sql("nf", "ni", [100, 500, 1000], (.25, .5, .75), inverse=True)))
def v2_ni(spark, d):
    return q_savings(spark, d, "nf", [100, 500, 1000], "ni", (.25, .5, .75))


@query("V3_savings_at_recall", with_views("runs", body=savings_sql("ni/total_ni", "nf", [.1, .5, .9], (.25, .5, .75))))
def v3(spark, d):
    r = runs(spark, d).withColumn("instance_f", F.col("ni") / F.col("total_ni"))
    rows = ev.savings_at(r, ["object_class"], "method", "instance_f", [.1, .5, .9], "nf", (.25, .5, .75))
    return rounded(rows, "lower", "metric", "upper", "ref", "ratio")


views.define("reach", """SELECT object_class, method, experiment_id, l AS level, min(nf) AS m
  FROM runs, (SELECT unnest([0.1::double, 0.5, 0.9]) AS l) WHERE ni/total_ni >= l GROUP BY ALL""", "runs")
views.define("vruns", """SELECT r.*, b.baseline, b.baseline / r.m AS savings FROM reach r LEFT JOIN (
  SELECT object_class, level, median(m) AS baseline FROM reach WHERE method = 'random+' GROUP BY ALL) b
  ON b.object_class = r.object_class AND b.level = r.level""", "reach")


def recalls(spark, d):
    return runs(spark, d).withColumn("instance_f", F.col("ni") / F.col("total_ni"))


def vruns(spark, d):
    return ev.run_savings(recalls(spark, d), ["object_class"], "instance_f", [.1, .5, .9], "nf", "random+")


@query("V4_run_savings", with_views("vruns", body="""
SELECT object_class, method, experiment_id, level, m AS metric, baseline, round(savings, 6) AS savings FROM vruns"""))
def v4(spark, d):
    return rounded(vruns(spark, d), "savings")


@query("V4_method_table", with_views("reach", body="""
SELECT object_class, round(exp(avg(ln(m)) FILTER (method = 'random')), 6) AS random, round(exp(avg(ln(m)) FILTER (method = 'random+')), 6) AS random_plus,
  round(exp(avg(ln(m)) FILTER (method = 'scored')), 6) AS scored FROM reach WHERE level = 0.5 GROUP BY 1"""))
def v4_table(spark, d):
    t = ev.method_table(recalls(spark, d), ["object_class"], "instance_f", .5, "nf", ["random", "random+", "scored"])
    return rounded(t.withColumnRenamed("random+", "random_plus"), "random", "random_plus", "scored")


LEVELS = [round(.05 * i, 2) for i in range(1, 19)]
SWEEP = savings_sql("ni", "nf", LEVELS, (.25, .5, .75), relative=True)
views.define("sweep", SWEEP.replace("round((ref+1)/(metric+1), 6)", "(ref+1)/(metric+1)"), "runs")


def sweep(spark, d):
    return ev.savings_at(runs(spark, d), ["object_class"], "method", "ni", LEVELS, "nf", (.25, .5, .75), relative=True)


@query("V5_savings_sweep", with_views("runs", body=SWEEP))
def v5(spark, d):
    return rounded(sweep(spark, d), "lower", "metric", "upper", "ref", "ratio")


@query("V6_savings_by_recall", with_views("sweep", body="""
SELECT method, rel_level, round(min(ratio), 6) AS min_savings, round(median(ratio), 6) AS median_savings, round(max(ratio), 6) AS max_savings, count(*) AS num_classes
FROM sweep GROUP BY ALL"""))
def v6(spark, d):
    return rounded(ev.spread_by(sweep(spark, d), ["method", "rel_level"]), "min_savings", "median_savings", "max_savings")


@query("V6_savings_by_dataset", with_views("sweep", body="""
SELECT method, round(min(g), 6) AS min_savings, round(median(g), 6) AS median_savings, round(max(g), 6) AS max_savings, count(*) AS num_classes
FROM (SELECT method, object_class, exp(avg(ln(ratio))) AS g FROM sweep GROUP BY ALL) GROUP BY 1"""))
def v6_ds(spark, d):
    g = sweep(spark, d).groupBy("method", "object_class").agg(ev.geometric_mean("ratio").alias("ratio"))
    return rounded(ev.spread_by(g, ["method"]), "min_savings", "median_savings", "max_savings")


@query("V7_geomean_rows", with_views("sweep", body="""
SELECT method, object_class, round(exp(avg(ln(ratio))), 6) AS ratio FROM sweep GROUP BY ALL
UNION ALL SELECT method, 'geomean', round(exp(avg(ln(ratio))), 6) FROM sweep GROUP BY 1"""))
def v7(spark, d):
    return rounded(ev.with_geomean_rows(sweep(spark, d), ["method"], "object_class", "ratio"), "ratio")


@query("V8_scan_equivalent", with_views("runs", body="""
SELECT dataset, object_class, median(ni) AS ni, median(nf) AS nf, max(total_ni) AS total_ni, max(total_nf) AS total_nf, max(total_nf)/200.0::double AS scan_time,
  max(total_nf)/200.0::double*20 AS random_eq, round(median(ni)/max(total_ni), 6) AS recall, round(median(nf)/20.0::double, 6) AS total_sec, round(median(nf)/max(total_nf), 6) AS fraction_data
FROM (SELECT dataset, object_class, experiment_id, max(ni) AS ni, max(nf) AS nf, max(total_ni) AS total_ni, max(total_nf) AS total_nf
  FROM runs WHERE method = 'random+' AND nf <= total_nf/200.0::double*20 GROUP BY ALL) GROUP BY ALL"""))
def v8(spark, d):
    r = runs(spark, d)
    scanned = r.groupBy("dataset").agg(F.max("total_nf").alias("frames"))
    return rounded(ev.scan_equivalent(r, scanned, 200.0, 20.0, "random+"), "recall", "total_sec", "fraction_data")


@query("A19_found_within", with_views("runs", body="""
SELECT object_class, method, experiment_id, max(ni) AS max_ni FROM runs WHERE nf <= 300 GROUP BY ALL"""))
def a19(spark, d):
    return ev.found_within(runs(spark, d), 300, ["object_class", "method"])


@query("A20_experiments_per_key", with_views("runs", body="""
SELECT method, object_class, total_ni, total_nf, count(DISTINCT experiment_id) AS experiments FROM runs GROUP BY ALL"""))
def a20(spark, d):
    return ev.experiments_per_key(runs(spark, d), ["method", "object_class", "total_ni", "total_nf"])


# Phase, frames timed, seconds they took.
PHASES = (("label", 500, 25.0), ("train", 2000, 16.0), ("score", 2000, 20.0), ("sample", 500, 24.5))
PHASE_SQL = ("phases AS (SELECT 'det' AS dataset, phase, xput, total_frames, cast(floor(total_frames / xput) AS bigint) AS est_seconds FROM (SELECT phase, nframes / duration AS xput, "
             "CASE phase WHEN 'label' THEN 120::double WHEN 'train' THEN 120 WHEN 'score' THEN n - 120 ELSE 0.1::double * (n - 120) END AS total_frames FROM (VALUES "
             + ", ".join(f"('{p}', {n}, {s}::double)" for p, n, s in PHASES) + ") t(phase, nframes, duration), (SELECT max(total_nf)::double AS n FROM runs)))")


def phases(spark, d):
    ds = runs(spark, d).groupBy("dataset").agg(F.max("total_nf").alias("n"))
    timed = ds.select("dataset", "n", F.inline(F.array(*[
        F.struct(F.lit(p).alias("phase"), F.lit(n).alias("nframes"), F.lit(s).alias("duration")) for p, n, s in PHASES])))
    return ev.phase_estimates(timed, F.col("n"), train_frames=120)


@query("V9_costs", with_views("runs", extra=PHASE_SQL, body="""
SELECT experiment_id, object_class, nf, overhead, round(nf / x, 6) AS sample_time, round(overhead + nf / x, 6) AS total_time FROM (
  SELECT r.*, CASE WHEN method = 'scored' THEN (SELECT sum(est_seconds) FROM phases WHERE phase <> 'sample') ELSE 0 END::bigint AS overhead,
  (SELECT xput FROM phases WHERE phase = 'sample') AS x FROM runs r)"""))
def v9(spark, d):
    c = ev.with_costs(runs(spark, d), phases(spark, d), ["scored"])
    return rounded(c.select("experiment_id", "object_class", "nf", "overhead", "sample_time", "total_time"), "sample_time", "total_time")


@query("V10_phase_estimates", with_views("runs", extra=PHASE_SQL, body="""
SELECT dataset, phase, round(xput, 6) AS xput, total_frames, est_seconds FROM phases"""))
def v10(spark, d):
    return rounded(phases(spark, d).select("dataset", "phase", "xput", "total_frames", "est_seconds"), "xput")


@query("V11_proxy_cost_table", """
SELECT event_type AS name, frames, task, rate, round(fp*frames, 6) AS frames_proxy, round(fp*frames/rate, 6) AS time_proxy, round(fr*frames, 6) AS frames_random, round(fr*frames/rate, 6) AS time_random
FROM (SELECT event_type, count(*) AS frames FROM events GROUP BY 1), (VALUES ('expensive inference', 20::double, 0.1::double, 0::double),
  ('scanning+cheap inference', 100, 1, 0), ('random access + decode', 20, 0.0001, 0.01)) t(task, rate, fp, fr)""")
def v11(spark, d):
    from queries.views import table
    c = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("frames"))
    return rounded(ev.proxy_cost_table(c), "frames_proxy", "time_proxy", "frames_random", "time_random")


views.define("vq", """SELECT 'det' AS dataset, 'savings in frames' AS metric, level, method, object_class, quantile_cont(savings, 0.2) AS q2, quantile_cont(savings, 0.5) AS q5, quantile_cont(savings, 0.8) AS q8
  FROM vruns GROUP BY ALL""", "vruns")
views.define("vt", """SELECT * FROM vq UNION ALL SELECT dataset, metric, level, method, 'geomean', NULL, exp(avg(ln(q5))), NULL FROM vq GROUP BY ALL""", "vq")


def vtable(spark, d):
    r = vruns(spark, d).withColumn("dataset", F.lit("det")).withColumn("metric", F.lit("savings in frames"))
    return ev.savings_quantiles(r, ["dataset", "metric", "level", "method"], "scored", "savings in frames")


@query("V12_savings_quantiles", with_views("vt", extra="""
o AS (SELECT object_class, dense_rank() OVER (ORDER BY object_class = 'geomean' DESC, g DESC, object_class) - 1 AS order_key FROM (
  SELECT object_class, exp(avg(ln(q5))) AS g FROM vt WHERE method = 'scored' GROUP BY 1))""", body="""
SELECT dataset, metric, level, method, vt.object_class, round(q2, 6) AS q2, round(q5, 6) AS q5, round(q8, 6) AS q8, order_key
FROM vt LEFT JOIN o ON o.object_class = vt.object_class"""))
def v12(spark, d):
    return rounded(vtable(spark, d), "q2", "q5", "q8")


@query("V13_renormalized", with_views("vq", body="""
SELECT a.level, a.object_class, a.method, round(a.q2/b.q2, 6) AS q2, round(a.q5/b.q5, 6) AS q5, round(a.q8/b.q8, 6) AS q8
FROM vq a JOIN vq b ON b.level = a.level AND b.object_class = a.object_class AND b.method = 'random'"""))
def v13(spark, d):
    q = vtable(spark, d).where("object_class <> 'geomean'")
    return rounded(ev.renormalize(q, ["level", "object_class"], "random", ["q2", "q5", "q8"]), "q2", "q5", "q8")


@query("V14_side_by_side", with_views("vt", body="""
SELECT object_class, level, round(max(q5) FILTER (method = 'scored'), 6) AS scored, round(max(q5) FILTER (method = 'random'), 6) AS random,
  round(max(q5) FILTER (method = 'scored') / max(q5) FILTER (method = 'random'), 6) AS ratio FROM vt GROUP BY ALL"""))
def v14(spark, d):
    return rounded(ev.side_by_side(vtable(spark, d), ["object_class", "level"], "scored", "random"), "scored", "random", "ratio")


@query("V15_rank_rows", with_views("vq", body="""
SELECT level, method, object_class, round(q5, 6) AS q5, row_number() OVER (PARTITION BY level, method ORDER BY round(q5, 6) DESC, object_class) - 1 AS order_ref FROM vq"""))
def v15(spark, d):
    q = rounded(vtable(spark, d).where("object_class <> 'geomean'"), "q5")
    return ev.rank_rows(q, ["level", "method"], "q5", "order_ref", ["object_class"]).select("level", "method", "object_class", "q5", "order_ref")


@query("V16_first_rows", """
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (
  PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS r FROM lineitem WHERE l_quantity >= 5) WHERE r <= 5""")
def v16(spark, d):
    from queries.views import table
    li = table(spark, d, "lineitem").where("l_quantity >= 5")
    return ev.first_rows(li, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"], 5).select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("P14_recode", with_views("runs", body="""
SELECT CASE method WHEN 'random+' THEN 'stride' WHEN 'scored' THEN 'score' ELSE method END AS method, count(*) AS n FROM runs GROUP BY 1"""))
def p14(spark, d):
    named = runs(spark, d).withColumn("method", ev.recode("method", {"random+": "stride", "scored": "score"}))
    return named.groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("Q9_config_grid", with_views("hits", body="""
SELECT object_class, order_by, split, object_class || '_' || order_by || '_' || split AS method, total_ni FROM (
  SELECT category AS object_class, count(DISTINCT track_id) AS total_ni FROM hits GROUP BY 1),
  (SELECT unnest(['random', 'random+']) AS order_by), (SELECT unnest(['nosplit', '30 min', '10 min']) AS split)"""))
def q9(spark, d):
    grid = ev.config_grid(spark, object_class=views.CATEGORIES, order_by=["random", "random+"], split=["nosplit", "30 min", "10 min"])
    totals = prep.category_totals(usable(spark, d), frames(spark, d), excluded(spark, d))
    return grid.join(totals, grid.object_class == totals.category).select("object_class", "order_by", "split", "method", "total_ni")

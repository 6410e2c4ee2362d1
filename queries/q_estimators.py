from pyspark.sql import functions as F

from framesift.operators import estimators as E
from framesift.operators import prep, stats
from framesift.plans import bounds
from framesift.session import cut_lineage
from queries import views
from queries.q_evaluate import runs
from queries.q_stats import FOF, pm, rounded, slog
from queries.registry import query
from queries.views import CATEGORIES, det, det_big, det_skew, frames, usable, video_len, with_views

views.define("tp", "SELECT category, track_id, count(*) / (SELECT count(*) FROM frames)::double AS p FROM usable GROUP BY ALL", "usable", "frames")


def tp(spark, d):
    return prep.track_totals(usable(spark, d)).select("category", "track_id", (F.col("track_length") / F.lit(float(video_len(spark, d)))).alias("p"))


STEPS = (1, 10, 100, 500, 3000)
FORMS = {"exact": "1 - exp(n * ln(1 - p))", "poisson": "1 - exp(-n * p)", "low_discrepancy": "least(n * p, 1)"}


@query("E1_expected_finds", with_views("tp", body=" UNION ALL ".join(f"""
SELECT '{k}' AS form, category, n, round(sum({v}), 6) AS expected FROM tp, (SELECT unnest([1::double, 10, 100, 500, 3000]) AS n) GROUP BY ALL""" for k, v in FORMS.items())))
def e1(spark, d):
    parts = [E.expected_finds(tp(spark, d), STEPS, form=f).withColumn("form", F.lit(f)) for f in FORMS]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), "expected")


#: Frames that the expectation is told for: 30 days of ten minutes each.
HORIZON = 4320
GRID = sorted(set(E.step_grid(HORIZON)))


@query("E2_expected_by_class", with_views("tp", body=f"""
SELECT category AS object_class, n AS frames_inspected, round(sum(1 - exp(n * ln(1 - p))), 6) AS n_ground_matched, count(*) AS num_ground, 'expected_random' AS sampler_name,
  round(n / 4320, 8) AS sample_fraction, 4320::bigint AS num_frames, round(sum(1 - exp(n * ln(1 - p))) / count(*), 8) AS recall
FROM tp, (SELECT unnest({GRID}::bigint[]) AS n) GROUP BY category, n"""))
def e2(spark, d):
    return rounded(rounded(E.expected_by_class(tp(spark, d), HORIZON), "n_ground_matched"), "sample_fraction", "recall", places=8)


HIST = """hist AS (SELECT bin, sum(c) AS h, min(lo) + bin * ln(1.2::double) AS ln_x FROM (
  SELECT least(s, max(s) OVER () - 1) AS bin, c, lo FROM (SELECT cast(round_even((ln(p) - lo) / ln(1.2::double), 0) AS bigint) AS s, count(*) AS c, min(lo) AS lo
    FROM tp, (SELECT ln(min(p)) AS lo FROM tp) GROUP BY 1)) GROUP BY 1)"""


@query("E3_fingerprint_finds", with_views("tp", extra=HIST, body="""
SELECT 'poisson' AS form, n, round(sum(h * (1 - exp(-n * exp(ln_x)))), 5) AS expected FROM hist, (SELECT unnest([1::double, 10, 100, 500, 3000]) AS n) GROUP BY n
UNION ALL SELECT 'future', n, round(sum(h * pow(1 - exp(ln_x), 200) * (1 - pow(1 - exp(ln_x), n))), 5) FROM hist, (SELECT unnest([1::double, 10, 100, 500, 3000]) AS n) GROUP BY n"""))
def e3(spark, d):
    h = stats.log_grid_histogram(tp(spark, d), "p")
    a = E.fingerprint_finds(h, STEPS).withColumn("form", F.lit("poisson"))
    b = E.future_finds(h.withColumn("x", F.exp("ln_x")), STEPS, seen=200).withColumn("form", F.lit("future"))
    return rounded(a.unionByName(b), "expected", places=5)


views.define("w", "SELECT chunk_id, count(*) AS w, (chunk_id % 5) - 2.0::double AS direction FROM usable GROUP BY 1", "usable")
views.define("track_x", "SELECT category, track_id, sum(p * w) AS x, sum(p * direction) AS q FROM pm JOIN w USING (chunk_id) GROUP BY ALL", "pm", "w")


def weights(spark, d):
    w = usable(spark, d).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("w")).withColumn("direction", (F.col("chunk_id") % 5) - F.lit(2.0))
    return w.withColumn("category", F.explode(F.array(*map(F.lit, CATEGORIES))))


@query("E4_misses", with_views("track_x", body="""
SELECT category, round(sum(exp(-x)), 6) AS misses, round(ln(sum(exp(-x))), 6) AS log_misses FROM track_x GROUP BY 1"""))
def e4(spark, d):
    return rounded(E.misses(pm(spark, d), weights(spark, d)), "misses", "log_misses")


@query("E5_miss_derivatives", with_views("track_x", body="""
SELECT category, chunk_id, round(-2 * sum(p * exp(-2*x)), 7) AS gradient, round(4 * sum(p * exp(-2*x) * q), 7) AS hessian_direction
FROM pm JOIN track_x USING (category, track_id) GROUP BY ALL"""))
def e5(spark, d):
    return rounded(E.miss_derivatives(pm(spark, d), weights(spark, d), n=2.0), "gradient", "hessian_direction", places=7)


@query("E5_log_miss_derivatives", with_views("track_x", extra="""
s AS (SELECT category, track_id, q, exp(-x) / sum(exp(-x)) OVER (PARTITION BY category) AS l FROM track_x),
m AS (SELECT category, sum(l * q) AS mq FROM s GROUP BY 1)""", body="""
SELECT category, chunk_id, round(-sum(p * l), 8) AS gradient, round(sum(p * l * (q - mq)), 8) AS hessian_direction
FROM pm JOIN s USING (category, track_id) JOIN m USING (category) GROUP BY ALL"""))
def e5_log(spark, d):
    return rounded(E.miss_derivatives(pm(spark, d), weights(spark, d), log=True), "gradient", "hessian_direction", places=8)


def skew_p(spark, d):
    return cut_lineage(stats.p_matrix(det_skew(spark, d), frames(spark, d)), "skew-p")


@query("E6_optimal_allocation")
def e6(spark, d):
    p = skew_p(spark, d)
    targets = p.select("category").distinct().withColumn("n", F.explode(F.array(F.lit(300.0), F.lit(1500.0))))
    return bounds.optimal_allocation(p, targets)


@query("E6_allocation_recount", with_views("det_skew", body="""
SELECT category, n, n AS total, false AS negative, 0.0::double AS misses_off
FROM (SELECT DISTINCT category FROM det_skew), (SELECT unnest([300::double, 1500]) AS n)"""))
def e6_recount(spark, d):
    """The counts add up to the target, none is negative, and the misses are those of the counts."""
    p = skew_p(spark, d)
    targets = p.select("category").distinct().withColumn("n", F.explode(F.array(F.lit(300.0), F.lit(1500.0))))
    best = cut_lineage(bounds.optimal_allocation(p, targets), "best")
    lost = E.misses(p.join(targets, "category"), best.drop("misses"), ["category", "n"]).select("category", "n", F.col("misses").alias("again"))
    told = best.groupBy("category", "n").agg(F.round(F.sum("w"), 6).alias("total"), (F.min("w") < 0).alias("negative"), F.max("misses").alias("misses"))
    return told.join(lost, ["category", "n"]).select("category", "n", "total", "negative", F.round(F.abs(F.col("misses") - F.col("again")), 6).alias("misses_off"))


def uniform_targets(p):
    objects = p.groupBy("category").agg(F.count_distinct("track_id").alias("t"))
    return objects.select("category", F.explode(F.array(F.lit(.9), F.lit(.5), F.lit(.1))).alias("share"), "t").select(
        "category", F.col("share").cast("string").alias("target_id"), (F.col("share") * F.col("t")).alias("misses"))


@query("E7_uniform_match")
def e7(spark, d):
    p = skew_p(spark, d)
    return bounds.uniform_match(p, uniform_targets(p), 30)


@query("E7_uniform_recount", with_views("det_skew", body="""
SELECT category, cast(share AS varchar) AS target_id, round(share * t, 4) AS misses
FROM (SELECT category, count(DISTINCT track_id) AS t FROM det_skew GROUP BY 1), (SELECT unnest([0.9::double, 0.5, 0.1]) AS share)"""))
def e7_recount(spark, d):
    """What is missed with the matching uniform counts: what was asked for."""
    p = skew_p(spark, d)
    found = bounds.uniform_match(p, uniform_targets(p), 30)
    x = p.groupBy("category", "track_id").agg((F.sum("p") / 30).alias("x")).join(found, "category")
    return x.groupBy("category", "target_id").agg(F.round(F.sum(F.exp(-F.col("n_uniform") * F.col("x"))), 4).alias("misses"))


@query("E8_bound_table")
def e8(spark, d):
    return bounds.bound_table(skew_p(spark, d), 30, penalties=5)


XS = E.probability_grid(0.0005, 0.02, 1.3)


@query("E9_expected_fingerprint", with_views("det_big", extra="""
fof AS (SELECT k, count(*) AS f FROM (SELECT track_id, count(*) AS k FROM det_big GROUP BY 1) GROUP BY 1),
g AS (SELECT x, 40.0::double * x / (SELECT sum(k*f) FROM fof) * 0 + 1000 * x AS h FROM (SELECT unnest(""" + f"{XS}" + """::double[]) AS x)),
ks AS (SELECT unnest(range(1, (SELECT max(k) + 1 FROM fof))) AS k),
n AS (SELECT sum(k*f)::double AS n FROM fof),
e AS (SELECT ks.k, sum(h * exp(ks.k * ln(x * 0.05 * n) - x * 0.05 * n - lgamma(ks.k + 1.0::double))) AS expected FROM ks, g, n GROUP BY 1)""".replace("40.0::double * x / (SELECT sum(k*f) FROM fof) * 0 + 1000 * x", "1000 * x").replace("x * 0.05 * n", "x * n"), body="""
SELECT e.k, coalesce(f, 0) AS f, round(expected, 5) AS expected, round(abs(expected - coalesce(f, 0)) / sqrt(coalesce(f, 0) + 1), 5) AS misfit FROM e LEFT JOIN fof ON fof.k = e.k"""))
def e9(spark, d):
    fof = stats.sample_fingerprint(det_big(spark, d), "track_id")
    c = spark.createDataFrame([(x, 1000 * x) for x in XS], "x double, h double")
    return rounded(E.expected_fingerprint(fof, c), "expected", "misfit", places=5)


@query("E10_split_fingerprint", with_views("det_big", extra="""
fof AS (SELECT k, count(*) AS f FROM (SELECT track_id, count(*) AS k FROM det_big GROUP BY 1) GROUP BY 1)""", body="""
SELECT k, f, CASE WHEN mass < sqrt(k) THEN 'sparse' ELSE 'dense' END AS part, round(CASE WHEN mass < sqrt(k) THEN k / (SELECT sum(k*f) FROM fof) END, 10) AS x FROM (
  SELECT a.k, a.f, sum(b.f) AS mass FROM fof a JOIN fof b ON b.k >= greatest(1, a.k - ceil(sqrt(a.k))) AND b.k < least(a.k + ceil(sqrt(a.k)), (SELECT max(k) + 1 FROM fof)) GROUP BY ALL)"""))
def e10(spark, d):
    return rounded(E.split_fingerprint(stats.sample_fingerprint(det_big(spark, d), "track_id")), "x", places=10)


views.define("alloc", """SELECT category, chunk_id, count(*) / sum(count(*)) OVER (PARTITION BY category) AS share FROM det_skew GROUP BY category, chunk_id""", "det_skew")


def alloc(spark, d):
    n = det_skew(spark, d).groupBy("category").agg(F.array(*[F.count_if(F.col("chunk_id") == i) / F.count(F.lit(1)) for i in range(30)]).alias("allocation"))
    return n


@query("E11_allocation_columns", with_views("alloc", body="SELECT category, " + ", ".join(
    f"round(coalesce(max(share) FILTER (chunk_id = {i}), 0), 8) AS chunk_{i}" for i in range(30)) + " FROM alloc GROUP BY 1"))
def e11(spark, d):
    return rounded(E.allocation_columns(alloc(spark, d), "category", 30), *[f"chunk_{i}" for i in range(30)], places=8)


@query("E11_used_chunks", with_views("alloc", body="""
SELECT chunk_id, round(max(share), 8) AS top_share FROM alloc GROUP BY 1 HAVING max(share) > 1/60.0::double"""))
def e11_used(spark, d):
    return rounded(E.used_chunks(alloc(spark, d), 30), "top_share", places=8)


@query("J3_expected_beside_found", with_views("runs", "tp", body="""
SELECT r.object_class, r.experiment_id, r.nf, r.ni, round(e.expected, 6) AS expected, round(r.ni - e.expected, 6) AS gap
FROM runs r LEFT JOIN (SELECT category, n, sum(1 - exp(n * ln(1 - p))) AS expected FROM tp, (SELECT unnest([1::double, 10, 100, 500, 3000]) AS n) GROUP BY ALL) e
ON e.category = r.object_class AND e.n = r.nf WHERE r.method = 'random'"""))
def j3(spark, d):
    e = E.expected_finds(tp(spark, d), STEPS).select(F.col("category").alias("object_class"), F.col("n").cast("long").alias("nf"), "expected")
    r = runs(spark, d).where("method = 'random'").join(e, ["object_class", "nf"], "left")
    return rounded(r.select("object_class", "experiment_id", "nf", "ni", "expected", (F.col("ni") - F.col("expected")).alias("gap")), "expected", "gap")

from pyspark.sql import functions as F

from framesift.functions.ordinal import exact_quantiles
from framesift.operators import orders, prep, stats
from queries import views
from queries.q_orders import plus_order
from queries.registry import query
from queries.views import CATEGORIES, det, det_big, det_skew, frames, hits, patches, table, usable, with_views

views.define("slog", """SELECT h.category AS experiment, f.frame_id, f.chunk_id, o.pos AS sample_id, t.track_id
  FROM (SELECT DISTINCT category FROM hits) h CROSS JOIN plus_order o JOIN frames f ON f.frame_id = o.frame_id
  LEFT JOIN hits t ON t.frame_id = o.frame_id AND t.category = h.category""", "plus_order", "frames", "hits")


def slog(spark, d):
    """Log of a complete stride-halving scan, one experiment per category."""
    q = plus_order(spark, d).join(frames(spark, d).select("frame_id", "chunk_id"), "frame_id")
    q = q.withColumnRenamed("pos", "sample_id").withColumn("experiment", F.explode(F.array(*map(F.lit, CATEGORIES))))
    h = hits(spark, d).withColumnRenamed("category", "experiment")
    return q.join(h, ["experiment", "frame_id"], "left")


@query("B1_B2_chunk_counters", with_views("slog", body="""
SELECT a.experiment, a.chunk_id, n_frames, n_hits, n_hit_frames, coalesce(n_once, 0) AS n_once, coalesce(n_unique, 0) AS n_unique FROM (
  SELECT experiment, chunk_id, count(*) AS n_frames, cast(sum(k) AS bigint) AS n_hits, count(*) FILTER (k > 0) AS n_hit_frames FROM (
    SELECT experiment, chunk_id, frame_id, count(track_id) AS k FROM slog GROUP BY ALL) GROUP BY ALL) a
LEFT JOIN (SELECT experiment, chunk_id, count(*) FILTER (n = 1) AS n_once, count(*) AS n_unique FROM (
    SELECT experiment, chunk_id, track_id, count(*) AS n FROM slog WHERE track_id IS NOT NULL GROUP BY ALL) GROUP BY ALL) b
ON a.experiment = b.experiment AND a.chunk_id = b.chunk_id"""))
def b12(spark, d):
    return stats.chunk_counters(slog(spark, d), ["experiment"])


FOF = """fof AS (SELECT experiment, k, count(*) AS f FROM (
  SELECT experiment, track_id, count(*) AS k FROM slog WHERE track_id IS NOT NULL GROUP BY ALL) GROUP BY ALL)"""


@query("B3_counts_of_counts", with_views("slog", extra=FOF, body="SELECT * FROM fof"))
def b3(spark, d):
    return stats.counts_of_counts(slog(spark, d), ["experiment"])


@query("B3_counts_of_counts_by_chunk", with_views("slog", body="""SELECT experiment, chunk_id, k, count(*) AS f FROM (
  SELECT experiment, chunk_id, track_id, count(*) AS k FROM slog WHERE track_id IS NOT NULL GROUP BY ALL) GROUP BY ALL"""))
def b3_chunk(spark, d):
    return stats.counts_of_counts(slog(spark, d), ["experiment", "chunk_id"])


@query("B4_good_turing", with_views("det_big", body="""
SELECT category, round(sum(CASE WHEN k = 1 THEN f ELSE 0 END) / sum(k * f), 8) AS unseen_mass FROM (
  SELECT category, k, count(*) AS f FROM (SELECT category, track_id, count(*) AS k FROM det_big GROUP BY ALL) GROUP BY ALL) GROUP BY 1"""))
def b4(spark, d):
    return stats.good_turing(stats.counts_of_counts(det_big(spark, d), ["category"]), ["category"]).withColumn(
        "unseen_mass", F.round("unseen_mass", 8))


@query("B5_good_toulmin", with_views("slog", extra=FOF, body="""
SELECT experiment, steps, round(-sum(f * pow(-steps / n, k)), 6) AS expected_new
FROM (SELECT *, sum(k * f) OVER (PARTITION BY experiment) AS n FROM fof), (SELECT unnest([1::double, 10, 100, 400]) AS steps) GROUP BY ALL
UNION ALL SELECT DISTINCT event_type || ' unseen', steps, steps FROM events, (SELECT unnest([1::double, 10, 100, 400]) AS steps)"""))
def b5(spark, d):
    fof = stats.counts_of_counts(slog(spark, d), ["experiment"])
    kinds = table(spark, d, "events").select(F.explode(F.array("event_type", F.concat("event_type", F.lit(" unseen")))).alias("experiment"))
    return stats.good_toulmin(fof, [1, 10, 100, 400], ["experiment"], kinds).withColumn("expected_new", F.round("expected_new", 6))


@query("B10_choice_shares", with_views("plus_order", "frames", "open_frames", body="""
SELECT cast(n AS int) AS n, chunk_id, round(sum(CASE WHEN pos < n THEN 1 ELSE 0 END) / min(least(n, (SELECT count(*) FROM open_frames))), 8) AS share
FROM plus_order o JOIN frames f ON f.frame_id = o.frame_id, (SELECT unnest([100, 300, 600, 1000, 3000, 6000, 10000, 30000]) AS n)
GROUP BY ALL"""))
def b10(spark, d):
    samples = plus_order(spark, d).join(frames(spark, d), "frame_id").select("pos", "chunk_id")
    return stats.choice_shares(samples, frames(spark, d), [100, 300, 600, 1000, 3000, 6000, 10000, 30000]).withColumn(
        "share", F.round("share", 8))


def hist_sql(src, x, bins, part=None, w="1", density=False, back="{}"):
    over = f"PARTITION BY {part}" if part else ""
    p = f"{part}, " if part else ""
    width = f"((hi - lo) / {bins})"
    dens = f", round(freq / sum(freq) OVER ({over}) / ({back.format(f'lo + (bin + 1) * {width}')} - ({back.format(f'lo + bin * {width}')})), 6) AS density" if density else ""
    return f"""SELECT {p} bin, freq, round({back.format(f'lo + bin * {width}')}, 6) AS x_start, round({back.format(f'lo + (bin + 1) * {width}')}, 6) AS x_end{dens}
FROM (SELECT {p} cast(bin AS int) AS bin, lo, hi, cast(coalesce(freq, 0) AS bigint) AS freq FROM (
  SELECT {p} lo, hi, unnest(range({bins})) AS bin FROM (
    SELECT {p} CASE WHEN min(x)=max(x) THEN min(x)-0.5 ELSE min(x) END AS lo, CASE WHEN min(x)=max(x) THEN max(x)+0.5 ELSE max(x) END AS hi
    FROM (SELECT *, {x} AS x FROM {src}) {f'GROUP BY {part}' if part else ''})) g
LEFT JOIN (SELECT {p} cast(least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS int) AS bin, sum({w}) AS freq FROM (
    SELECT *, CASE WHEN mn=mx THEN mn-0.5 ELSE mn END AS lo, CASE WHEN mn=mx THEN mx+0.5 ELSE mx END AS hi FROM (
      SELECT *, min(x) OVER ({over}) AS mn, max(x) OVER ({over}) AS mx FROM (SELECT *, {x} AS x FROM {src}))) GROUP BY ALL) c
USING ({p} bin))"""


def rounded(df, *cols, places=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


LENGTHS = "lengths AS (SELECT category, track_id, count(*) AS track_length FROM {} GROUP BY ALL)"


@query("A3_log_length_histogram", with_views("usable", extra=LENGTHS.format("usable"),
       body=hist_sql("lengths", "ln(track_length::double)", 15, "category", back="exp({})")))
def a3(spark, d):
    h = stats.log_length_histogram(prep.track_totals(usable(spark, d)), "track_length", 15, ["category"])
    return rounded(h, "x_start", "x_end")


@query("A3_duration_density", with_views("det_big", extra=LENGTHS.format("det_big"),
       body=hist_sql("lengths", "track_length::double", 100, density=True)))
def a3_density(spark, d):
    t = prep.track_totals(det_big(spark, d)).select(F.col("track_length").cast("double").alias("x"))
    return rounded(stats.histogram(t, "x", 100, density=True), "x_start", "x_end", "density")


@query("A3_log10_histogram", hist_sql("orders", "log10(o_totalprice)", 40))
def a3_log10(spark, d):
    o = table(spark, d, "orders").select(F.log10("o_totalprice").alias("x"))
    return rounded(stats.histogram(o, "x", 40), "x_start", "x_end")


@query("A4_duration_counts", with_views("det_big", extra=LENGTHS.format("det_big"), body="""
SELECT 'count' AS kind, track_length::double AS x, count(*)::double AS y FROM lengths GROUP BY 2
UNION ALL SELECT 'at least', a, round((SELECT count(*) FROM lengths WHERE track_length >= a) / (SELECT count(*) FROM lengths), 8)
FROM (SELECT DISTINCT track_length::double AS a FROM lengths)"""))
def a4(spark, d):
    t = prep.track_totals(det_big(spark, d))
    a = stats.duration_counts(t, "track_length").select(F.lit("count").alias("kind"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    b = stats.duration_counts(t, "track_length", reverse_cumulative=True, relative_y=True)
    return a.unionByName(b.select(F.lit("at least").alias("kind"), F.col("x").cast("double").alias("x"), F.round("y", 8).alias("y")))


views.define("pm", """SELECT category, track_id, u.chunk_id, count(*) / max(s.n) AS p FROM usable u
  JOIN (SELECT chunk_id, count(*) AS n FROM frames GROUP BY 1) s ON s.chunk_id = u.chunk_id GROUP BY ALL""", "usable", "frames")


def pm(spark, d):
    return stats.p_matrix(usable(spark, d), frames(spark, d))


@query("A5_p_matrix", with_views("pm", body="SELECT category, track_id, chunk_id, round(p, 8) AS p FROM pm"))
def a5(spark, d):
    return rounded(pm(spark, d), "p", places=8)


@query("A5_p_matrix_wide", with_views("pm", body="SELECT category, track_id, " + ", ".join(
    f"round(coalesce(max(CASE WHEN chunk_id = {c} THEN p END), 0), 8) AS c{c}" for c in range(30)) + " FROM pm GROUP BY ALL"))
def a5_wide(spark, d):
    w = stats.p_matrix_wide(pm(spark, d), range(30))
    return w.select("category", "track_id", *[F.round(F.col(str(c)), 8).alias(f"c{c}") for c in range(30)])


@query("A6_p_matrix_intervals", """
SELECT track_id, chunk_id, round(count(*) / 200, 8) AS p FROM (
  SELECT track_id, cast(floor(f / 200) AS bigint) AS chunk_id FROM (
    SELECT o_orderkey AS track_id, unnest(range(s, s + 1 + o_custkey % 900)) AS f FROM (
      SELECT *, cast(date_diff('day', DATE '1992-01-01', cast(o_orderdate AS date)) AS bigint) AS s FROM orders))) GROUP BY ALL""")
def a6(spark, d):
    s = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("track_id"), s.alias("start"), (s + 1 + F.col("o_custkey") % 900).alias("end"))
    return rounded(stats.p_matrix_intervals(o, 200), "p", places=8)


views.define("psum", """SELECT g.category, g.chunk_id, coalesce(n, 0) AS n, mean_p, sqrt((q - mean_p*mean_p)/n) AS sigma, coalesce(s, 0) AS s, coalesce(q, 0) AS q, t
  FROM (SELECT category, chunk_id, t FROM (SELECT category, count(DISTINCT track_id) AS t FROM pm GROUP BY 1), (SELECT DISTINCT chunk_id FROM frames)) g
  LEFT JOIN (SELECT category, chunk_id, count(*) AS n, avg(p) AS mean_p, sum(p*p) AS q, sum(p) AS s FROM pm GROUP BY ALL) a
  ON a.category = g.category AND a.chunk_id = g.chunk_id""", "pm")


def psum(spark, d):
    return stats.chunk_p_summary(pm(spark, d), frames(spark, d))


@query("A7_chunk_p_summary", with_views("psum", body="SELECT category, chunk_id, n, round(mean_p, 8) AS mean_p, round(sigma, 8) AS sigma FROM psum"))
def a7(spark, d):
    return rounded(psum(spark, d), "mean_p", "sigma", places=8)


@query("A8_chunk_p_long", with_views("psum", body="""
SELECT category, chunk_id, m.metric AS metric, round(m.value, 7) AS value FROM (SELECT category, chunk_id, unnest([
  {'metric': 'sum_p', 'value': s}, {'metric': 'std_p', 'value': sqrt(greatest(q/t - s/t*s/t, 0))}, {'metric': 'mean_p', 'value': s/t}, {'metric': 'n', 'value': n::double}]) AS m FROM psum)"""))
def a8(spark, d):
    return rounded(stats.chunk_p_long(pm(spark, d), frames(spark, d)), "value", places=7)


@query("A9_rank_chunks", with_views("psum", body="""
SELECT category, chunk_id, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, chunk_id) - 1 AS rank FROM psum"""))
def a9(spark, d):
    return stats.rank_chunks(psum(spark, d)).select("category", "chunk_id", "n", "rank")


views.define("skewpm", """SELECT category, chunk_id, count(DISTINCT track_id) AS n FROM (
  SELECT category, chunk_id, track_id FROM det_skew UNION ALL SELECT NULL, NULL, NULL WHERE false) GROUP BY ALL""", "det_skew")


def skew_counts(spark, d):
    return det_skew(spark, d).groupBy("category", "chunk_id").agg(F.count_distinct("track_id").alias("n"))


SHARES = """ranked AS (SELECT *, row_number() OVER w - 1 AS rank, sum(n) OVER w AS cum, sum(n) OVER (PARTITION BY category) AS tot
  FROM skewpm WINDOW w AS (PARTITION BY category ORDER BY n DESC, chunk_id ROWS UNBOUNDED PRECEDING)),
flagged AS (SELECT *, coalesce(lag(cum / tot <= 0.5) OVER (PARTITION BY category ORDER BY n DESC, chunk_id), true) AS top FROM ranked)"""


@query("A10_skew_metric", with_views("skewpm", extra=SHARES, body="""
SELECT category, round(count(*) / (count(*) FILTER (cum / tot < 0.5) + 1), 8) AS skew FROM ranked GROUP BY 1"""))
def a10(spark, d):
    return rounded(stats.skew_metric(skew_counts(spark, d)), "skew", places=8)


@query("A11_skew_table", with_views("skewpm", extra=SHARES, body="""
SELECT category, round(count(*) * 0.5::double / count(*) FILTER (top), 8) AS skew, max(n) AS max_n, cast(sum(n) AS bigint) AS total_n, count(*) AS chunks
FROM flagged GROUP BY 1"""))
def a11(spark, d):
    return rounded(stats.skew_table(skew_counts(spark, d))[0], "skew", places=8)


@query("A11_skew_rows", with_views("skewpm", extra=SHARES, body="""
SELECT category, chunk_id, n, rank, top, 'by time' AS "order" FROM flagged
UNION ALL SELECT category, cast(rank AS int), n, rank, top, 'by n' FROM flagged"""))
def a11_rows(spark, d):
    return stats.skew_table(skew_counts(spark, d))[1].select("category", "chunk_id", "n", "rank", "top", "order")


@query("A12_contingency", with_views("det", body="SELECT track_id, " + ", ".join(
    f"round(count(*) FILTER (category = '{c}') / (SELECT count(*) FROM det WHERE category = '{c}'), 8) AS \"{c}\"" for c in CATEGORIES) + " FROM det GROUP BY 1"))
def a12(spark, d):
    return rounded(stats.contingency(det(spark, d), "track_id", "category", CATEGORIES), *CATEGORIES, places=8)


@query("A13_sample_fingerprint", "SELECT k, count(*) AS f FROM (SELECT l_partkey, count(*) AS k FROM lineitem GROUP BY 1) GROUP BY 1")
def a13(spark, d):
    return stats.sample_fingerprint(table(spark, d, "lineitem"), "l_partkey")


@query("A14_log_grid_histogram", with_views("pm", body="""
SELECT bin, cast(sum(c) AS bigint) AS h, round(min(lo) + bin * ln(1.2::double), 6) AS ln_x FROM (
  SELECT least(s, max(s) OVER () - 1) AS bin, c, lo FROM (
    SELECT cast(round_even((ln(p) - lo) / ln(1.2::double), 0) AS bigint) AS s, count(*) AS c, min(lo) AS lo
    FROM pm, (SELECT ln(min(p)) AS lo FROM pm) GROUP BY 1)) GROUP BY 1"""))
def a14(spark, d):
    return rounded(stats.log_grid_histogram(pm(spark, d), "p"), "ln_x").select("bin", "h", "ln_x")


@query("A15_soft_log_grid_histogram", with_views("pm", extra="""
g AS (SELECT i, lo + i * ln(1.3::double) AS g FROM (SELECT lo, unnest(range(m)) AS i FROM (
  SELECT ln(min(p)) AS lo, cast(round_even((ln(max(p)) - ln(min(p))) / ln(1.3::double), 0) AS bigint) AS m FROM pm))),
w AS (SELECT rid, i, g, exp(-abs(ln(p) - g) / ln(1.3::double) * ln(10::double)) AS w FROM (SELECT p, row_number() OVER () AS rid FROM pm), g)""", body="""
SELECT cast(i AS int) AS bin, round(min(g), 6) AS ln_x, round(sum(w / t), 5) AS h FROM (SELECT *, sum(w) OVER (PARTITION BY rid) AS t FROM w) GROUP BY 1"""))
def a15(spark, d):
    return rounded(rounded(stats.soft_log_grid_histogram(pm(spark, d), "p"), "ln_x"), "h", places=5)


views.define("est", """SELECT l_partkey AS k, count(*) AS n, count(*) FILTER (l_linenumber = 1) AS n_once, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) / (3.0::double * count(*)) AS e
  FROM lineitem GROUP BY 1""")


def est(spark, d):
    li = table(spark, d, "lineitem")
    n = F.count(F.lit(1))
    return li.groupBy(F.col("l_partkey").alias("k")).agg(
        n.alias("n"), F.count_if(F.col("l_linenumber") == 1).alias("n_once"),
        (F.count_if(F.col("l_quantity") > 25) / (F.lit(3.0) * n)).alias("e"))


COND = """q AS (SELECT e FROM est WHERE n BETWEEN 20 AND 40 AND n_once BETWEEN 2 AND 6),
ends AS (SELECT list_sort(list(e)) AS l, count(*) AS c FROM q),
cut AS (SELECT e FROM q, ends WHERE e BETWEEN l[cast(round_even(0.02 * (c - 1), 0) AS int) + 1] AND l[cast(round_even(0.98 * (c - 1), 0) AS int) + 1])"""


def cond(spark, d):
    return stats.conditional_histogram(est(spark, d), (20, 40), (2, 6), 0.02, 0.98)


@query("A16_conditional_histogram", with_views("est", extra=COND, body=hist_sql("cut", "e", 100, density=True)))
def a16(spark, d):
    return rounded(cond(spark, d), "x_start", "x_end", "density")


@query("A16_gamma_curves", with_views("est", extra=COND + ", h AS (" + hist_sql("cut", "e", 100).replace("round(lo + bin * ((hi - lo) / 100), 6)", "lo + bin * ((hi - lo) / 100)").replace("round(lo + (bin + 1) * ((hi - lo) / 100), 6)", "lo + (bin + 1) * ((hi - lo) / 100)") + "),"
       """ r AS (SELECT least(min((x_start + x_end)/2), 0.0) AS a, greatest(max((x_start + x_end)/2), 3.1/31 + 0) AS b FROM h),
m AS (SELECT 4.0::double AS n1, 30.0::double AS n),
z AS (SELECT least(a0, greatest(least(n1/n, (n1+.1)/(n+1)) - 2.5*sqrt(greatest(n1/n/n, (n1+.1)/(n+1)/(n+1))), 0)) AS a,
             greatest(b0, greatest(n1/n, (n1+.1)/(n+1)) + 2.5*sqrt(greatest(n1/n/n, (n1+.1)/(n+1)/(n+1)))) AS b, n1, n
      FROM (SELECT min((x_start + x_end)/2) AS a0, max((x_start + x_end)/2) AS b0 FROM h), m),
x AS (SELECT i, a + i*(b-a)/201 AS x, n1, n FROM (SELECT *, unnest(range(201)) AS i FROM z))""", body="""
SELECT cast(i AS int) AS i, round(x, 6) AS x, round(n1/n, 6) AS est, round(exp(n1*ln(n) + (n1-1)*ln(x) - n*x - lgamma(n1)), 5) AS density,
  round(exp((n1+.1)*ln(n+1) + (n1+.1-1)*ln(x) - (n+1)*x - lgamma(n1+.1)), 5) AS density_prior FROM x WHERE i > 0"""))
def a16_curves(spark, d):
    c = stats.gamma_curves(cond(spark, d), 4.0, 30.0).where("i > 0")
    return rounded(rounded(c, "x", "est"), "density", "density_prior", places=5)


def points(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("trip_id"), F.col("event_id").alias("point_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"),
        F.get_json_object("props", "$.k").cast("double").alias("lon"), F.col("value").alias("lat"),
        (F.col("event_id") % 10 != 0).alias("gps_valid"), F.col("value").alias("dist_km"))


@query("A17_trip_summary", """
SELECT user_id AS trip_id, min((epoch_us(ts) // 1000)) AS start, max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000)) AS duration,
  round(avg(CASE WHEN event_id % 10 <> 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_gps_valid, max(value) AS max_dist_km FROM events GROUP BY 1""")
def a17(spark, d):
    return rounded(stats.trip_summary(points(spark, d)), "pct_gps_valid")


@query("A17_trip_lines", """
SELECT trip_id, part, '{"type":"LineString","coordinates":[' || string_agg('[' || cast(lon AS varchar) || ',' || cast(lat AS varchar) || ']', ',' ORDER BY pos) || ']}' AS geojson
FROM (SELECT *, cast(floor(pos/40) AS bigint) AS part FROM (
  SELECT user_id AS trip_id, json_extract_string(props, '$.k')::double AS lon, value AS lat,
         row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) - 1 AS pos FROM events WHERE event_id % 10 <> 0)) GROUP BY ALL""")
def a17_lines(spark, d):
    return stats.trip_lines(points(spark, d), part_points=40)


@query("A18_grid_energy", with_views("patches", body="""
SELECT patch_id, round(sum(v*v), 5) AS energy, round(sum(CASE WHEN (i//8) < 2 OR (i//8) >= 6 OR i%8 < 2 OR i%8 >= 6 THEN v*v ELSE 0 END), 5) AS border_energy
FROM (SELECT patch_id, unnest(embedding)::double AS v, unnest(range(64)) AS i FROM patches) GROUP BY 1"""))
def a18(spark, d):
    vec = F.col("embedding").cast("array<double>")
    total, edge = stats.energy(vec, 8, 2)
    return patches(spark, d).select("patch_id", F.round(total, 5).alias("energy"), F.round(edge, 5).alias("border_energy"))


@query("A21_column_summary", """
SELECT stat, round(value, 5) AS value FROM (SELECT 'count' AS stat, count(o_totalprice)::double AS value FROM orders
UNION ALL SELECT 'mean', avg(o_totalprice) FROM orders UNION ALL SELECT 'std', stddev_samp(o_totalprice) FROM orders
UNION ALL SELECT 'min', min(o_totalprice) FROM orders UNION ALL SELECT 'max', max(o_totalprice) FROM orders
UNION ALL SELECT 'q0.01', quantile_cont(o_totalprice, 0.01) FROM orders UNION ALL SELECT 'q0.5', quantile_cont(o_totalprice, 0.5) FROM orders
UNION ALL SELECT 'q0.9', quantile_cont(o_totalprice, 0.9) FROM orders UNION ALL SELECT 'q0.99', quantile_cont(o_totalprice, 0.99) FROM orders)""")
def a21(spark, d):
    return rounded(stats.column_summary(table(spark, d, "orders"), "o_totalprice", [0.01, 0.5, 0.9, 0.99]), "value", places=5)


@query("A21_quantiles_by_key", " UNION ALL ".join(
    f"SELECT l_returnflag, {q}::double AS q, round(quantile_cont(l_extendedprice, {q}), 6) AS value FROM lineitem GROUP BY 1" for q in (0.25, 0.5, 0.75)))
def a21_keys(spark, d):
    return rounded(exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.75], by=["l_returnflag"]), "value")


@query("A22_estimator_check", with_views("est", extra="""
s AS (SELECT *, n_once / n AS x FROM est ORDER BY md5('6:' || k), k LIMIT 500), z AS (SELECT * FROM s WHERE e <> 0 AND x <> 0)""", body="""
SELECT k, n, n_once, round(e, 8) AS e, round(x, 8) AS est, round((SELECT least(min(e), min(x)) FROM z), 8) AS x_min,
  round((SELECT greatest(max(e), max(x)) FROM z), 8) AS x_max FROM z"""))
def a22(spark, d):
    return rounded(stats.estimator_check(est(spark, d), 500, 6, "k"), "e", "est", "x_min", "x_max", places=8)


@query("P15_banded_examples", with_views("est", extra="""
b AS (SELECT 'small' AS band, 3 AS kk, * FROM est WHERE n BETWEEN 1 AND 25 UNION ALL SELECT 'middle', 2, * FROM est WHERE n BETWEEN 20 AND 35
  UNION ALL SELECT 'none once', 1, * FROM est WHERE n > 25 AND n_once = 0 UNION ALL SELECT 'some once', 4, * FROM est WHERE n > 25 AND n_once > 0)""", body="""
SELECT band, k, n, n_once FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('2:' || k), k) AS r FROM b) WHERE r <= kk"""))
def p15(spark, d):
    n, once = F.col("n"), F.col("n_once")
    bands = [("small", n.between(1, 25), 3), ("middle", n.between(20, 35), 2),
             ("none once", (n > 25) & (once == 0), 1), ("some once", (n > 25) & (once > 0), 4)]
    return stats.banded_examples(est(spark, d), bands, 2, "k", "n").select("band", "k", "n", "n_once")

"""Sampling statistics, histograms and the chunk × track probability table.

A sampling log has one row per (experiment, sample_id, chunk, frame, track); a frame without a
hit has one row with a null track, so that it still counts as sampled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.ordinal import exact_quantiles, running, sampled_bucket, seed_key, value_ranges


def sampling_log(queue: DataFrame, hits: DataFrame) -> DataFrame:
    """Log of the given sampled frames, with a null track where nothing was found."""
    return queue.join(hits.select("frame_id", "track_id"), "frame_id", "left")


def chunk_counters(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per chunk: frames sampled, hit rows, frames with a hit, tracks seen once, distinct tracks.

    Tracks are counted once per (chunk, track) before the second level, so a hot track is one row.
    """
    keys = [*by, "chunk_id"]
    per_frame = log.groupBy(*keys, "frame_id").agg(F.count("track_id").alias("k"))
    frames = per_frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), F.sum("k").alias("n_hits"), F.count_if(F.col("k") > 0).alias("n_hit_frames")
    )
    per_track = log.where(F.col("track_id").isNotNull()).groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("n"))
    tracks = per_track.groupBy(*keys).agg(F.count_if(F.col("n") == 1).alias("n_once"), F.count(F.lit(1)).alias("n_unique"))
    return frames.join(tracks, keys, "left").fillna(0, ["n_once", "n_unique"])


def counts_of_counts(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, k, f): how many tracks were seen exactly k times."""
    per_track = log.where(F.col("track_id").isNotNull()).groupBy(*by, "track_id").agg(F.count(F.lit(1)).alias("k"))
    return per_track.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("f"))


def good_turing(fof: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mass of what was never seen: tracks seen once over sightings; 1 when nothing was seen."""
    n, once = F.sum(F.col("k") * F.col("f")), F.sum(F.when(F.col("k") == 1, F.col("f")).otherwise(0))
    return fof.groupBy(*by).agg(F.coalesce(F.when(n > 0, once / n), F.lit(1.0)).alias("unseen_mass"))


def good_toulmin(fof: DataFrame, steps: Sequence[float], by: Sequence[str] = (), keys: DataFrame | None = None) -> DataFrame:
    """New tracks expected in ``steps`` further sightings: minus the alternating power sum.

    Where nothing was seen yet, each step is expected to bring a new track; ``keys`` names the groups
    that may have no row in ``fof``.
    """
    totals = fof.groupBy(*by).agg(F.sum(F.col("k") * F.col("f")).alias("n"))
    rows = fof.join(totals, list(by)) if by else fof.withColumn("n", totals.scalar())
    wide = rows.withColumn("steps", F.explode(F.array(*[F.lit(float(s)) for s in steps])))
    found = wide.groupBy(*by, "steps").agg((-F.sum(F.col("f") * F.pow(-F.col("steps") / F.col("n"), F.col("k")))).alias("expected_new"))
    if keys is None and by:
        return found
    groups = keys.select(*by).distinct() if by else fof.sparkSession.range(1).select()
    every = groups.withColumn("steps", F.explode(F.array(*[F.lit(float(s)) for s in steps])))
    return every.join(found, [*by, "steps"], "left").withColumn("expected_new", F.coalesce("expected_new", "steps"))


def choice_shares(samples: DataFrame, chunks: DataFrame, after: Sequence[int]) -> DataFrame:
    """Share of each chunk among the first N choices, for several N in one pass."""
    counts = samples.groupBy("chunk_id").agg(
        F.array(*[F.struct(F.lit(n).alias("n"), F.count_if(F.col("pos") < n).alias("c")) for n in after]).alias("cs")
    )
    dense = chunks.select("chunk_id").distinct().join(counts, "chunk_id", "left")
    empty = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(0).cast("long").alias("c")) for n in after])
    long = dense.select("chunk_id", F.inline(F.coalesce("cs", empty)))
    totals = long.groupBy("n").agg(F.sum("c").alias("total"))
    return long.join(F.broadcast(totals), "n").select("n", "chunk_id", (F.col("c") / F.col("total")).alias("share"))


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = (), weight: str | None = None,
              density: bool = False) -> DataFrame:
    """Equal-width bins over [min, max] per key, empty bins included; the top bin is closed."""
    lo, hi = F.col("__lo"), F.col("__hi")
    span = df.groupBy(*by).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    flat = lo == hi
    span = span.select(*by, F.when(flat, lo - 0.5).otherwise(lo).alias("__lo"), F.when(flat, hi + 0.5).otherwise(hi).alias("__hi"))
    if by:
        rows = df.join(span, list(by))
    else:
        rows = df.withColumn("__s", span.select(F.struct("__lo", "__hi").alias("s")).scalar()).select("*", "__s.*")
    bin_ = F.least(F.floor((F.col(col) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = rows.groupBy(*by, bin_.alias("bin")).agg(n.alias("freq"))
    grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [*by, "bin"], "left").fillna(0, ["freq"])
    width = (hi - lo) / bins
    out = out.select(*by, "bin", "freq", (lo + F.col("bin") * width).alias("x_start"), (lo + (F.col("bin") + 1) * width).alias("x_end"))
    if density:
        total = out.groupBy(*by).agg(F.sum("freq").alias("__t"))
        out = out.join(total, list(by)) if by else out.withColumn("__t", total.scalar())
        out = out.withColumn("density", F.col("freq") / F.col("__t") / (F.col("x_end") - F.col("x_start"))).drop("__t")
    return out


def log_length_histogram(lengths: DataFrame, col: str, bins: int, by: Sequence[str]) -> DataFrame:
    """Histogram of ln(length) with the bin edges mapped back to lengths."""
    folded = lengths.groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n")).withColumn("__ln", F.log(F.col(col).cast("double")))
    h = histogram(folded, "__ln", bins, by, weight="__n")
    return h.withColumn("x_start", F.exp("x_start")).withColumn("x_end", F.exp("x_end"))


def duration_counts(lengths: DataFrame, col: str, reverse_cumulative: bool = False,
                    relative_y: bool = False, x_total: int | None = None) -> DataFrame:
    """Count per duration, or the number at least that long; optional relative axes."""
    ranges = value_ranges(lengths, col)
    total = ranges.agg(F.max("hi")).scalar()
    y = (total - F.col("lo")) if reverse_cumulative else F.col("n")
    y = y / total if relative_y else y
    x = F.col(col) if x_total is None else F.col(col) / x_total
    return ranges.select(x.alias("x"), y.alias("y"))


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("chunk_size"))


def p_matrix(ok_boxes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Long sparse table (category, track_id, chunk_id, p): rows of a track in a chunk over chunk size."""
    placed = ok_boxes.select("category", "track_id", "frame_id").join(chunks.select("frame_id", "chunk_id"), "frame_id")
    counted = placed.groupBy("category", "track_id", "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(chunk_sizes(chunks), "chunk_id").select(
        "category", "track_id", "chunk_id", (F.col("n") / F.col("chunk_size")).alias("p")
    )


def p_matrix_wide(p: DataFrame, chunk_ids: Sequence[int]) -> DataFrame:
    """One column per chunk, 0 where the track never is; ``chunk_ids`` names all chunks."""
    wide = p.groupBy("category", "track_id").pivot("chunk_id", list(chunk_ids)).agg(F.first("p"))
    return wide.fillna(0.0)


def p_matrix_intervals(intervals: DataFrame, chunk_size: int) -> DataFrame:
    """The same from track intervals [start, end) and equal chunks, without listing the frames."""
    first, last = F.floor(F.col("start") / chunk_size), F.floor((F.col("end") - 1) / chunk_size)
    cut = intervals.where(F.col("end") > F.col("start")).withColumn("chunk_id", F.explode(F.sequence(first, last)))
    inside = F.least(F.col("end"), (F.col("chunk_id") + 1) * chunk_size) - F.greatest(F.col("start"), F.col("chunk_id") * chunk_size)
    return cut.groupBy("track_id", "chunk_id").agg((F.sum(inside) / chunk_size).alias("p"))


def chunk_p_summary(p: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per (category, chunk): tracks present, mean p and the spread sqrt((Σp² − mean²)/N); every chunk listed."""
    grid = _category_chunks(p, chunks)
    agg = p.groupBy("category", "chunk_id").agg(
        F.count_if(F.col("p") > 0).alias("n"), F.avg("p").alias("mean_p"), F.sum(F.col("p") * F.col("p")).alias("__q"))
    spread = F.sqrt((F.col("__q") - F.col("mean_p") * F.col("mean_p")) / F.col("n"))
    return grid.join(agg, ["category", "chunk_id"], "left").select(
        "category", "chunk_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean_p", spread.alias("sigma"))


def _category_chunks(p: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk for every category; the category list is the short side."""
    names = p.select("category").distinct().agg(F.collect_list("category"))
    return chunks.select("chunk_id").distinct().withColumn("category", F.explode(names.scalar()))


def chunk_p_long(p: DataFrame, chunks: DataFrame) -> DataFrame:
    """(category, chunk, metric, value) for sum, population spread and mean of p over all tracks, and N.

    Tracks absent from a chunk count as 0; they enter through the track total only.
    """
    tracks = p.groupBy("category").agg(F.count_distinct("track_id").alias("t"))
    agg = p.groupBy("category", "chunk_id").agg(
        F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"), F.count_if(F.col("p") > 0).alias("c"))
    rows = _category_chunks(p, chunks).join(agg, ["category", "chunk_id"], "left").fillna(0).join(tracks, "category")
    mean = F.col("s") / F.col("t")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("t") - mean * mean, F.lit(0.0)))
    return rows.select("category", "chunk_id", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"))
        for m, v in (("sum_p", F.col("s")), ("std_p", spread), ("mean_p", mean), ("n", F.col("c")))])))


def rank_chunks(summary: DataFrame, by: Sequence[str] = ("category",), col: str = "n") -> DataFrame:
    """Chunks ranked by ``col``, most first (one row per chunk, so the window is short)."""
    w = Window.partitionBy(*by).orderBy(F.col(col).desc(), "chunk_id")
    return summary.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))


def skew_metric(summary: DataFrame, fraction: float = 0.5, by: Sequence[str] = ("category",)) -> DataFrame:
    """Chunks over the chunks needed for ``fraction`` of the objects, taken richest first."""
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "chunk_id")
    whole = Window.partitionBy(*by)
    share = summary.withColumn("__share", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(whole))
    return share.groupBy(*by).agg(
        (F.count(F.lit(1)) / (F.count_if(F.col("__share") < fraction) + 1)).alias("skew"))


def skew_table(summary: DataFrame, fraction: float = 0.5, by: Sequence[str] = ("category",)) -> tuple[DataFrame, DataFrame]:
    """Skew with the largest chunk, total and chunk count; and the chunk rows flagged ``top`` in both orders."""
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "chunk_id")
    total = F.sum("n").over(Window.partitionBy(*by))
    within = (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total) <= fraction
    ranked = rank_chunks(summary, by).withColumn("__within", within)
    flagged = ranked.withColumn("top", F.coalesce(F.lag("__within").over(w), F.lit(True))).drop("__within")
    table = flagged.groupBy(*by).agg(
        (F.count(F.lit(1)) * fraction / F.count_if("top")).alias("skew"), F.max("n").alias("max_n"),
        F.sum("n").alias("total_n"), F.count(F.lit(1)).alias("chunks"))
    long = flagged.withColumn("order", F.lit("by time")).unionByName(
        flagged.withColumn("chunk_id", F.col("rank").cast(flagged.schema["chunk_id"].dataType)).withColumn("order", F.lit("by n")))
    return table, long


def contingency(rows: DataFrame, instance: str, split: str, values: Sequence, normalize: bool = True) -> DataFrame:
    """Instance × split counts, or each column divided by its sum."""
    counts = rows.groupBy(instance).agg(*[F.count_if(F.col(split) == v).alias(str(v)) for v in values])
    if not normalize:
        return counts
    sums = counts.agg(F.struct(*[F.sum(F.col(f"`{v}`")).alias(str(v)) for v in values]))
    wide = counts.withColumn("__sums", sums.scalar())
    return wide.select(instance, *[(F.col(f"`{v}`") / F.col("__sums")[str(v)]).alias(str(v)) for v in values])


def sample_fingerprint(samples: DataFrame, col: str) -> DataFrame:
    """(k, f): how many values occur exactly k times."""
    return samples.groupBy(col).agg(F.count(F.lit(1)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("f"))


def log_grid_histogram(probs: DataFrame, col: str, step: float = 1.2) -> DataFrame:
    """Histogram of positive probabilities on a geometric grid from the smallest; (bin, ln_x, h)."""
    pos = probs.where(F.col(col) > 0)
    lo = pos.agg(F.log(F.min(col)).alias("lo")).scalar()
    stepped = pos.select(F.rint((F.log(col) - lo) / math.log(step)).cast("long").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    top = stepped.agg(F.max("s")).scalar()
    hist = stepped.groupBy(F.least(F.col("s"), top - 1).alias("bin")).agg(F.sum("c").alias("h"))
    return hist.withColumn("ln_x", lo + F.col("bin") * math.log(step))


def soft_log_grid_histogram(probs: DataFrame, col: str, step: float = 1.3) -> DataFrame:
    """Each probability spread over the grid by softmax of −ln 10 · distance in grid steps; (bin, ln_x, h).

    Equal probabilities are folded first; the grid is one short array.
    """
    folded = probs.where(F.col(col) > 0).groupBy(F.log(col).alias("lp")).agg(F.count(F.lit(1)).alias("c"))
    lo, width = F.min("lp"), F.lit(math.log(step))
    bins = F.rint((F.max("lp") - lo) / width).cast("int")
    grid = folded.agg(F.transform(F.sequence(F.lit(0), bins - 1), lambda i: lo + i * width)).scalar()
    raw = F.transform("grid", lambda g: F.exp(-F.abs(F.col("lp") - g) / width * math.log(10.0)))
    rows = folded.withColumn("grid", grid).withColumn("w", raw)
    rows = rows.withColumn("total", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    cells = rows.select("c", "total", F.posexplode(F.arrays_zip("grid", "w")).alias("bin", "cell"))
    return cells.groupBy("bin").agg(
        F.min("cell.grid").alias("ln_x"), F.sum(F.col("cell.w") / F.col("total") * F.col("c")).alias("h"))


def conditional_histogram(tuples: DataFrame, n: tuple[float, float], n_once: tuple[float, float], min_q: float = 0.0,
                          max_q: float = 1.0, bins: int = 100) -> DataFrame:
    """Density of E over the rows whose (n, N1) lie in the ranges, trimmed at nearest quantiles."""
    rows = tuples.where(F.col("n").between(*n) & F.col("n_once").between(*n_once))
    ends = exact_quantiles(rows, "e", [min_q, max_q], interpolation="nearest").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    kept = rows.withColumn("__q", ends.select(F.struct("a", "b")).scalar()).where(F.col("e").between(F.col("__q.a"), F.col("__q.b")))
    return histogram(kept, "e", bins, density=True)


def gamma_density(x: Column, shape: float, rate: float) -> Column:
    return F.exp(shape * math.log(rate) + (shape - 1) * F.log(x) - rate * x - math.lgamma(shape))


def gamma_curves(hist: DataFrame, n_once: float, n: float, alpha: float = 0.1, beta: float = 1.0, points: int = 201) -> DataFrame:
    """Gamma(N1, n) and Gamma(N1 + .1, n + 1) densities on a grid that covers the histogram and both means."""
    m1, m2 = n_once / n, (n_once + alpha) / (n + beta)
    sd = math.sqrt(max(n_once / n**2, (n_once + alpha) / (n + beta) ** 2))
    mid = (F.col("x_start") + F.col("x_end")) / 2
    ends = hist.agg(F.least(F.min(mid), F.lit(max(min(m1, m2) - 2.5 * sd, 0.0))).alias("a"),
                    F.greatest(F.max(mid), F.lit(max(m1, m2) + 2.5 * sd)).alias("b"))
    grid = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    xs = grid.select("i", (F.col("a") + F.col("i") * (F.col("b") - F.col("a")) / points).alias("x"))
    return xs.withColumns({"density": gamma_density(F.col("x"), n_once, n),
                           "density_prior": gamma_density(F.col("x"), n_once + 0.1, n + 1.0), "est": F.lit(m1)})


def estimator_check(tuples: DataFrame, sample: int, seed, key: str) -> DataFrame:
    """``sample`` random rows with est = N1/n beside E, zero rows removed, with the common range."""
    picked = tuples.withColumn("est", F.col("n_once") / F.col("n")).orderBy(seed_key(seed, key), key).limit(sample)
    kept = picked.where((F.col("e") != 0) & (F.col("est") != 0))
    ends = kept.agg(F.struct(F.least(F.min("e"), F.min("est")).alias("x_min"), F.greatest(F.max("e"), F.max("est")).alias("x_max")))
    return kept.withColumn("__r", ends.scalar()).select(*kept.columns, "__r.x_min", "__r.x_max")


def banded_examples(rows: DataFrame, bands: Sequence[tuple[str, Column, int]], seed, key: str, sort: str) -> DataFrame:
    """``k`` random rows of every band (name, condition, k); a row may serve several bands."""
    named = F.filter(F.array(*[F.when(cond, F.struct(F.lit(name).alias("band"), F.lit(k).alias("__k"))) for name, cond, k in bands]),
                     lambda b: b.isNotNull())
    hit = rows.select("*", F.inline(named))
    w = Window.partitionBy("band").orderBy(seed_key(seed, key), key)
    picked = hit.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(k for _, _, k in bands)).where(F.col("__r") <= F.col("__k"))
    return picked.drop("__r", "__k").orderBy(sort)


def column_summary(df: DataFrame, col: str, qs: Sequence[float]) -> DataFrame:
    """Count, mean, deviation, ends and exact quantiles as (stat, value) rows."""
    base = df.agg(F.count(col).cast("double").alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                  F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"))
    stats = base.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("value")) for c in base.columns])))
    return stats.unionByName(exact_quantiles(df, col, qs).select(F.concat(F.lit("q"), F.col("q").cast("string")).alias("stat"), "value"))


def trip_summary(points: DataFrame) -> DataFrame:
    """Per trip: start, duration in seconds, share of valid fixes in percent, largest distance."""
    return points.groupBy("trip_id").agg(
        F.min("time").alias("start"), (F.max("time") - F.min("time")).alias("duration"),
        (F.avg(F.col("gps_valid").cast("double")) * 100).alias("pct_gps_valid"), F.max("dist_km").alias("max_dist_km"))


def trip_lines(points: DataFrame, part_points: int = 5000) -> DataFrame:
    """Valid fixes of every trip in time order as GeoJSON lines of at most ``part_points`` points.

    A long trip becomes several consecutive parts, so no row holds an unbounded list.
    """
    valid = points.where(F.col("gps_valid"))
    order = [F.col("time"), F.col("point_id")]
    placed = running(valid, order, sampled_bucket(valid, order), by=["trip_id"]).withColumn("part", F.floor(F.col("pos") / part_points))
    lists = placed.groupBy("trip_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("ps"))
    coords = F.transform("ps", lambda q: F.array(q["lon"], q["lat"]))
    return lists.select("trip_id", "part", F.to_json(F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates"))).alias("geojson"))


def energy(vector: Column, width: int, border: int) -> tuple[Column, Column]:
    """Sum of squares of a row-major grid, and of its border only (the centre set to 0)."""
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)

    def at_edge(i):
        row, col = F.floor(i / width), i % width
        height = F.size(vector) / width
        return (row < border) | (row >= height - border) | (col < border) | (col >= width - border)

    edge = F.aggregate(F.filter(vector, lambda x, i: at_edge(i)), F.lit(0.0), lambda a, x: a + x * x)
    return total, edge

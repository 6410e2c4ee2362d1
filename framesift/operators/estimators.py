"""Estimators of what is still unseen, from probabilities or from counts of counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.ordinal import block_of, running


def _with_steps(df: DataFrame, steps: Sequence[float]) -> DataFrame:
    return df.withColumn("n", F.explode(F.array(*[F.lit(float(s)) for s in steps])))


def hit_probability(p: Column, n: Column, form: str = "exact") -> Column:
    """Chance to meet an object of probability p in n draws: exact, poisson or low_discrepancy (min(np, 1))."""
    if form == "exact":
        return F.when(p >= 1, (n > 0).cast("double")).otherwise(1 - F.exp(n * F.log1p(-p)))
    if form == "poisson":
        return -F.expm1(-n * p)
    if form == "low_discrepancy":
        return F.least(n * p, F.lit(1.0))
    raise ValueError(form)


def expected_finds(p: DataFrame, steps: Sequence[float], by: Sequence[str] = ("category",), form: str = "exact") -> DataFrame:
    """Expected distinct finds after each number of uniform draws.

    Equal probabilities fold into one weighted row first.  Probabilities that sum to 1 in every
    group would count misses as objects and are refused.
    """
    by = list(by)
    folded = p.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("c"))
    sums = folded.groupBy(*by).agg(F.sum(F.col("p") * F.col("c")).alias("s"))
    all_one = sums.agg(F.min((F.abs(F.col("s") - 1) < 0.01).cast("int"))).scalar()
    safe = F.when(all_one == 1, F.raise_error(F.lit("probabilities sum to 1: are misses counted as objects?")).cast("double")).otherwise(F.col("p"))
    rows = _with_steps(folded, steps)
    return rows.groupBy(*by, "n").agg(F.sum(F.col("c") * hit_probability(safe, F.col("n"), form)).alias("expected"))


def step_grid(size: int) -> list[int]:
    """Sample sizes from 1/10000 to 1/10 of a collection, eight per decade, each with its successor."""
    base = [math.floor(size * 10 ** (-4 + 0.125 * i)) for i in range(25)]
    return sorted(base + [b + 1 for b in base])


def expected_by_class(p: DataFrame, size: int, form: str = "exact") -> DataFrame:
    """Expected finds on the sample-size grid per class, with totals, fraction and recall."""
    steps = sorted(set(step_grid(size)))
    totals = p.groupBy("category").agg(F.count(F.lit(1)).alias("num_ground"))
    e = expected_finds(p, steps, form=form).join(totals, "category")
    return e.select(F.col("category").alias("object_class"), F.col("n").cast("long").alias("frames_inspected"), F.col("expected").alias("n_ground_matched"),
                    "num_ground", F.lit("expected_random" if form == "exact" else "expected_lsb").alias("sampler_name"),
                    (F.col("n") / size).alias("sample_fraction"), F.lit(size).cast("long").alias("num_frames"),
                    (F.col("expected") / F.col("num_ground")).alias("recall"))


def fingerprint_finds(hist: DataFrame, steps: Sequence[float]) -> DataFrame:
    """Expected finds from a histogram (h objects at ln-probability ln_x), Poisson form."""
    return _with_steps(hist, steps).groupBy("n").agg(F.sum(F.col("h") * (1 - F.exp(-F.col("n") * F.exp("ln_x")))).alias("expected"))


def future_finds(hist: DataFrame, steps: Sequence[float], seen: int = 0) -> DataFrame:
    """New finds in further draws when ``seen`` draws are done: objects weigh their chance of being unseen."""
    unseen = F.col("h") * F.pow(1 - F.col("x"), F.lit(float(seen)))
    return _with_steps(hist, steps).groupBy("n").agg(F.sum(unseen * (1 - F.pow(1 - F.col("x"), F.col("n")))).alias("expected"))


def exposure(p: DataFrame, w: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per track: Σ over chunks of p·w."""
    return p.join(w, [*keys, "chunk_id"]).groupBy(*keys, "track_id").agg(F.sum(F.col("p") * F.col("w")).alias("x"))


def misses(p: DataFrame, w: DataFrame, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Expected missed tracks for per-chunk sample counts, and their logarithm by log-sum-exp."""
    x = exposure(p, w, keys)
    top = x.groupBy(*keys).agg(F.min("x").alias("__m"))
    return x.join(top, list(keys)).groupBy(*keys).agg(
        F.sum(F.exp(-F.col("x"))).alias("misses"),
        (F.log(F.sum(F.exp(F.col("__m") - F.col("x")))) - F.max("__m")).alias("log_misses"))


def miss_derivatives(p: DataFrame, w: DataFrame, n: float = 1.0, log: bool = False, keys: Sequence[str] = ("category",)) -> DataFrame:
    """Per chunk: gradient of the misses in w, and the Hessian times ``direction``.

    ``w`` has (keys…, chunk_id, w, direction); tracks are weighed by exp(−n·Σpw), or by its softmax when
    ``log``.  The Hessian enters as a product with a direction (two aggregations); its full matrix
    would pair every two chunks of every track.
    """
    keys = list(keys)
    rows = p.join(w, [*keys, "chunk_id"])
    t = rows.groupBy(*keys, "track_id").agg((n * F.sum(F.col("p") * F.col("w"))).alias("x"), F.sum(F.col("p") * F.col("direction")).alias("q"))
    if log:
        z = t.groupBy(*keys).agg(F.min("x").alias("__m"))
        t = t.join(z, keys).withColumn("l", F.exp(F.col("__m") - F.col("x")))
        total = t.groupBy(*keys).agg(F.sum("l").alias("__z"), F.sum(F.col("l") * F.col("q")).alias("__lq"))
        t = t.join(total, keys).withColumn("l", F.col("l") / F.col("__z")).withColumn("mean_q", F.col("__lq") / F.col("__z"))
    else:
        t = t.withColumn("l", F.exp(-F.col("x"))).withColumn("mean_q", F.lit(0.0))
    weighed = p.join(t.select(*keys, "track_id", "l", "q", "mean_q"), [*keys, "track_id"])
    pull = F.sum(F.col("p") * F.col("l") * (F.col("q") - F.col("mean_q")))
    return weighed.groupBy(*keys, "chunk_id").agg((-n * F.sum(F.col("p") * F.col("l"))).alias("gradient"), (n * n * pull).alias("hessian_direction"))


def probability_grid(smallest: float, largest: float, factor: float = 1.05) -> list[float]:
    """Geometric grid from the smallest probability to at least the largest."""
    size = math.ceil(math.log(largest * factor / smallest) / math.log(factor))
    return [smallest * factor**i for i in range(size)]


def expected_fingerprint(fof: DataFrame, candidate: DataFrame) -> DataFrame:
    """(k, f, expected, misfit): counts of counts beside Σ h(x)·Poisson(k; N·x) for a candidate histogram.

    ``candidate`` (x, h) is a short grid.  Use it on the dense part of a fingerprint, whose largest
    k bounds the rows.
    """
    n = fof.agg(F.sum(F.col("k") * F.col("f"))).scalar()
    top = fof.agg(F.max("k")).first()[0]
    ks = fof.sparkSession.range(1, (top or 0) + 1).withColumnRenamed("id", "k")
    ks = running(ks, [F.col("k")], block_of(F.col("k")), value=F.log(F.col("k").cast("double")), name="ln_fact")
    grid = candidate.agg(F.collect_list(F.struct("x", "h"))).scalar()
    rate = lambda c: c["x"] * F.col("n")
    mass = lambda c: c["h"] * F.exp(F.col("k") * F.log(rate(c)) - rate(c) - F.col("ln_fact"))
    rows = ks.withColumn("n", n).withColumn("grid", grid)
    rows = rows.withColumn("expected", F.aggregate(F.transform("grid", mass), F.lit(0.0), lambda a, x: a + x)).drop("grid", "n", "ln_fact")
    out = rows.join(fof.select("k", "f"), "k", "left").fillna(0, ["f"])
    return out.withColumn("misfit", F.abs(F.col("expected") - F.col("f")) / F.sqrt(F.col("f") + 1))


def fingerprint_loss(table: DataFrame) -> DataFrame:
    return table.agg(F.sum("misfit").alias("loss"))


def split_fingerprint(fof: DataFrame) -> DataFrame:
    """(k, f, part, x): a count is sparse when the mass within ⌈√k⌉ of it is below √k.

    Counts meet only neighbours whose square-root block is at most two away, never all others.
    """
    n = fof.agg(F.sum(F.col("k") * F.col("f"))).scalar()
    top = fof.agg(F.max("k")).scalar() + 1
    block = F.floor(F.sqrt("k"))
    near = fof.select(F.col("k").alias("j"), F.col("f").alias("fj"), F.explode(F.sequence(block - 2, block + 2)).alias("__b"))
    reach = F.ceil(F.sqrt("k"))
    rows = fof.withColumn("__b", block).withColumn("__top", top).join(near, "__b").where(
        (F.col("j") >= F.greatest(F.lit(1), F.col("k") - reach)) & (F.col("j") < F.least(F.col("k") + reach, F.col("__top"))))
    mass = rows.groupBy("k", "f").agg(F.sum("fj").alias("mass"))
    sparse = F.col("mass") < F.sqrt("k")
    return mass.select("k", "f", F.when(sparse, "sparse").otherwise("dense").alias("part"), F.when(sparse, F.col("k") / n).alias("x"))


def allocation_columns(allocations: DataFrame, key: str, chunks: int) -> DataFrame:
    """Allocation arrays as one column per chunk."""
    return allocations.select(key, *[F.col("allocation")[i].alias(f"chunk_{i}") for i in range(chunks)])


def used_chunks(allocations: DataFrame, chunks: int) -> DataFrame:
    """(chunk_id, top_share) of chunks whose share ever exceeds half the even share."""
    long = allocations.select(F.posexplode("allocation").alias("chunk_id", "share"))
    return long.groupBy("chunk_id").agg(F.max("share").alias("top_share")).where(F.col("top_share") > 1 / (2 * chunks))

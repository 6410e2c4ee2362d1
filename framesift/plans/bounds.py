"""Bounds: the best split of samples over chunks when all probabilities are known.

Every step is one aggregation over the lists of p of all tracks; many targets (sample sizes or penalties)
move together as a key column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions.ordinal import exact_quantiles
from framesift.session import cut_lineage


def _by_track(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(category, track_id, ps, s) with a track's (chunk number, p) in a list, and (category, chunk_id, at) with the numbers.

    A list is as long as the chunks its track is seen in.
    """
    at = F.row_number().over(Window.partitionBy("category").orderBy("chunk_id"))
    chunks = cut_lineage(p.select("category", "chunk_id").distinct().withColumn("at", at), "chunks")
    of = p.join(chunks, ["category", "chunk_id"]).groupBy("category", "track_id")
    return cut_lineage(of.agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("ps"), F.sum("p").alias("s")), "tracks"), chunks


def _pull(tracks: DataFrame, w: DataFrame, target: str) -> DataFrame:
    """Per chunk Σ p·exp(−Σpw), how much one more sample there is worth, and a bound on how fast that falls.

    With the largest p of the chunk, and the misses and the objects of its target.  The counts ``w`` (category, target,
    chunk_id, at, w) go to the tracks, one row per category; from these only sums per chunk are passed on.
    """
    keys = ["category", target]
    lists = w.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("ws"))
    each = F.collect_list(F.struct(F.col(target), F.col("ws.w").alias("ws"))).alias("each")
    # The planner takes the product of two tables for the size of their join; this side is one number per chunk and target.
    met = tracks.join(F.broadcast(lists.groupBy("category").agg(each)), "category").select("category", "ps", "s", F.explode("each").alias("e"))
    left = F.exp(-F.aggregate("ps", F.lit(0.0), lambda total, x: total + x["p"] * F.get("e.ws", x["at"] - 1)))
    seen = met.select("category", F.col(f"e.{target}").alias(target), "s", "ps", left.alias("l"))
    seen = seen.select(*keys, "s", "l", F.posexplode("ps").alias("i", "x"))
    pull, once = F.col("x.p") * F.col("l"), F.col("i") == 0
    worth = seen.groupBy(*keys, F.col("x.at").alias("at")).agg(
        F.sum(pull).alias("g"), F.sum(pull * F.col("s")).alias("fall"), F.max("x.p").alias("top"),
        F.sum(F.when(once, F.col("l")).otherwise(0.0)).alias("__l"), F.count_if(once).alias("__n"))
    whole = Window.partitionBy(*keys)
    worth = worth.withColumns({"misses": F.sum("__l").over(whole), "objects": F.sum("__n").over(whole)}).drop("__l", "__n")
    return w.join(worth, [*keys, "at"])


def _proven(state: DataFrame, gap: Column, keys: Sequence[str], tolerance: float) -> bool:
    """Whether no target could miss fewer by more than ``tolerance`` of its objects.

    The misses are convex in the counts, so ``gap``, an aggregate over a target's chunks, bounds what is left to gain.
    """
    worst = state.groupBy(*keys).agg((gap / F.max("objects")).alias("__gap")).agg(F.max("__gap")).first()[0]
    return worst is None or worst <= tolerance


def optimal_allocation(p: DataFrame, targets: DataFrame, steps: int = 200, tolerance: float = 0.01) -> DataFrame:
    """Best sample counts per chunk for fixed totals.

    ``targets`` has (category, n).  Multiplicative steps on the simplex: a chunk's share grows with
    the square root of its worth over the mean worth.  Ends when the duality gap of every target is at
    most ``tolerance`` of its objects; an error tells when ``steps`` do not get there.
    """
    keys = ["category", "n"]
    tracks, chunks = _by_track(p)
    w = chunks.join(targets, "category").withColumn("w", F.col("n") / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    gap = F.max("g") * F.max("n") - F.sum(F.col("g") * F.col("w"))
    for _ in range(steps):
        state = cut_lineage(_pull(tracks, w, "n"), "alloc")
        if _proven(state, gap, keys, tolerance):
            return state.select(*keys, "chunk_id", "w", "misses")
        grown = state.withColumn("__v", F.col("w") * F.sqrt("g"))
        total = grown.groupBy(*keys).agg(F.sum("__v").alias("__t"))
        w = grown.join(total, keys).select(*keys, "chunk_id", "at", (F.col("__v") / F.col("__t") * F.col("n")).alias("w"))
    raise RuntimeError(f"the gap is above {tolerance} of the objects after {steps} steps")


def penalised_allocation(p: DataFrame, penalties: DataFrame, steps: int = 200, tolerance: float = 0.01) -> DataFrame:
    """Sample counts that minimise penalty·Σw + misses, for (category, lam) rows.

    At the optimum a used chunk's worth equals the penalty.  Every step moves all chunks by their distance to
    that over a bound on the slope, no further than the exponentials can be trusted and not below zero.  Ends
    like ``optimal_allocation``; the best total costs no more than the present one, which bounds it.
    """
    keys = ["category", "lam"]
    tracks, chunks = _by_track(p)
    w = chunks.join(penalties, "category").withColumn("w", 1 / F.col("lam") / F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    most = F.least(F.max("objects") / F.max("lam"), F.sum("w") + F.max("misses") / F.max("lam"))
    gap = F.sum((F.col("lam") - F.col("g")) * F.col("w")) + F.greatest(F.max("g") - F.max("lam"), F.lit(0.0)) * most
    for _ in range(steps):
        state = cut_lineage(_pull(tracks, w, "lam"), "pen")
        if _proven(state, gap, keys, tolerance):
            return state.select(*keys, "chunk_id", "w", "misses")
        move = F.greatest(F.least((F.col("g") - F.col("lam")) / F.col("fall"), 2 / F.col("top")), -1 / F.col("top"))
        w = state.select(*keys, "chunk_id", "at", F.greatest(F.col("w") + move, F.lit(0.0)).alias("w"))
    raise RuntimeError(f"the gap is above {tolerance} of the objects after {steps} steps")


def uniform_match(p: DataFrame, targets: DataFrame, chunks: int, rounds: int = 6, parts: int = 32) -> DataFrame:
    """Uniform sample count with the same misses as each target (category, target_id, misses).

    Misses fall with n, so each round keeps one of ``parts`` sub-intervals; all targets together.
    """
    x = p.groupBy("category", "track_id").agg((F.sum("p") / chunks).alias("x"))
    folded = cut_lineage(x.groupBy("category", "x").agg(F.count(F.lit(1)).alias("c")), "match")
    keys = ["category", "target_id"]
    lowest = folded.groupBy("category").agg(F.min("x").alias("__x"), F.sum("c").alias("__t"))
    span = targets.join(lowest, "category").select(*keys, "misses", F.lit(0.0).alias("lo"), (F.log(F.col("__t") / F.col("misses")) / F.col("__x")).alias("hi"))
    for _ in range(rounds):
        tries = span.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(parts)))).withColumn("n", F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / parts)
        tried = tries.join(folded, "category").groupBy(*keys, "misses", "lo", "hi", "n").agg(F.sum(F.col("c") * F.exp(-F.col("n") * F.col("x"))).alias("m"))
        high = F.min(F.when(F.col("m") <= F.col("misses"), F.col("n")))
        span = cut_lineage(tried.groupBy(*keys, "misses", "lo", "hi").agg(F.coalesce(high, F.col("hi")).alias("h")).select(
            *keys, "misses", (F.col("h") - (F.col("hi") - F.col("lo")) / parts).alias("lo"), F.col("h").alias("hi")), "match")
    return span.select(*keys, "misses", F.col("hi").alias("n_uniform"))


def penalty_grid(p: DataFrame, count: int = 8) -> DataFrame:
    """(category, lam): geometric penalties from the .99 quantile of chunk sums down to an eighth of the least."""
    sums = p.groupBy("category", "chunk_id").agg(F.sum("p").alias("s")).where("s > 0")
    ends = exact_quantiles(sums, "s", [0.99, 0.0], by=["category"]).groupBy("category").agg(F.max("value").alias("a"), (F.min("value") / 8).alias("b"))
    share = F.col("i") / (count - 1)
    return ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select(
        "category", F.exp((1 - share) * F.log("a") + share * F.log("b")).alias("lam"))


def bound_table(p: DataFrame, chunks: int, penalties: int = 8, steps: int = 200) -> DataFrame:
    """Per penalty: optimal and uniform sample counts, their ratio, distance of the shares to uniform, recall.

    A penalty so high that it is best to take nothing has null ratio and distance.
    """
    lam = penalty_grid(p, penalties)
    best = penalised_allocation(p, lam, steps)
    total = F.sum("w").over(Window.partitionBy("category", "lam"))
    even = 1.0 / chunks
    shares = best.withColumn("__s", F.try_divide("w", total))
    per = shares.groupBy("category", "lam").agg(
        F.sum("w").alias("opt_n"), F.first("misses").alias("misses"),
        F.sqrt(F.sum(F.pow(F.col("__s") - even, F.lit(2.0))) + (chunks - F.count(F.lit(1))) * even * even).alias("w_distance"))
    per = cut_lineage(per.withColumn("target_id", F.col("lam").cast("string")), "bound")
    uniform = uniform_match(p, per.select("category", "target_id", "misses"), chunks)
    objects = p.groupBy("category").agg(F.count_distinct("track_id").alias("objects"))
    return per.join(uniform.drop("misses"), ["category", "target_id"]).join(objects, "category").select(
        "category", "lam", "opt_n", "n_uniform", F.try_divide("n_uniform", "opt_n").alias("ratio"), "w_distance",
        ((F.col("objects") - F.col("misses")) / F.col("objects")).alias("recall"))

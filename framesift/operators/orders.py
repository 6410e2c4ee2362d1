"""Frame orders: which frame is looked at first.  Each returns rows with a 0-based ``pos``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.ordinal import hex_bucket, hex_unit, positions, running, seed_key


def random_order(frames: DataFrame, seed) -> DataFrame:
    """Uniform permutation of the given frames (exclude first; a permutation of the rest is uniform)."""
    keyed = frames.select("frame_id", seed_key(seed, "frame_id").alias("__key"))
    ranked = running(keyed, [F.col("__key"), F.col("frame_id")], hex_bucket(F.col("__key"), 3))
    return ranked.select("frame_id", "pos")


def random_draw(frames: DataFrame, seed, batch: int, step: int = 0) -> DataFrame:
    """The ``step``-th batch of a draw without replacement."""
    return next_batch(random_order(frames, seed), step * batch, batch)


def stride_levels(size: int, initial_step: int = 256, initial_offset: int = 0) -> list[tuple[int, int]]:
    """(step, offset) of every visiting level of the stride-halving order."""
    step = max(1, min(initial_step, size // 4))
    offset, levels = initial_offset, []
    while step >= 1:
        offset %= step
        levels.append((step, offset))
        step //= 2
    return levels


def stride_level(frame: Column, levels: Sequence[tuple[int, int]]) -> Column:
    """First level that visits the frame; the last level (step 1) visits all."""
    return F.coalesce(*[F.when(frame % step == offset, F.lit(k)) for k, (step, offset) in enumerate(levels)])


def stride_halving_order(frames: DataFrame, size: int, seed=None, score: str | None = None,
                         initial_step: int = 256, initial_offset: int = 0) -> DataFrame:
    """Visit every step-th frame, halve the step, visit the rest; inside a level by score or at random.

    The level is a closed expression of the frame number, so the only exchange is the one that
    numbers the rows.
    """
    levels = stride_levels(size, initial_step, initial_offset)
    keyed = frames.withColumn("__level", stride_level(F.col("frame_id"), levels)).withColumn(
        "__key", seed_key(0 if seed is None else seed, "frame_id")
    )
    if score is None:
        order = [F.col("__level"), F.col("__key"), F.col("frame_id")]
        ranked = running(keyed, order, F.col("__level") * 4096 + hex_bucket(F.col("__key"), 3))
    else:
        ranked = positions(keyed, [F.col("__level"), -F.col(score), F.col("__key"), F.col("frame_id")])
    return ranked.select("frame_id", F.col("__level").alias("level"), "pos")


def next_batch(order: DataFrame, start, n: int, excluded: DataFrame | None = None) -> DataFrame:
    """The ``n`` rows of an order from position ``start`` on.

    With ``excluded``, that frame set is skipped first and positions count the frames left.
    """
    left = order
    if excluded is not None:
        kept = order.join(excluded.select("frame_id"), "frame_id", "left_anti")
        left = positions(kept.withColumnRenamed("pos", "__old"), [F.col("__old")]).drop("__old")
    return left.where((F.col("pos") >= start) & (F.col("pos") < F.lit(start) + n))


def rank_scores(scores: DataFrame, by: Sequence[str], score: str, seed, tie: Sequence[str]) -> DataFrame:
    """Rank by score, best first, ties at random, per draw."""
    keyed = scores.withColumn("__key", seed_key(seed, *by, *tie))
    return positions(keyed, [-F.col(score), F.col("__key")], by=by, name="rank").drop("__key")


def score_order(frames: DataFrame, score: str, seed=0, by: Sequence[str] = ()) -> DataFrame:
    """Best score first, ties in seeded random order."""
    return rank_scores(frames, by, score, seed, ["frame_id"]).withColumnRenamed("rank", "pos")


def frame_score_sums(hits: DataFrame, track_scores: DataFrame, score: str) -> DataFrame:
    """Score of a frame: the sum over its tracks."""
    return hits.join(track_scores, "track_id").groupBy("frame_id").agg(F.sum(score).alias("score"))


def bit_reversed_order(rows: DataFrame, ts: Column, key: str) -> DataFrame:
    """Low-discrepancy order of timestamps: sort by the 64 bits of the nanosecond clock, reversed."""
    keyed = rows.withColumn("__bits", F.reverse(F.lpad(F.bin(ts), 64, "0")))
    # The leading bits of a round clock are constant, so cut points are sampled, not a fixed prefix.
    return positions(keyed, [F.col("__bits"), F.col(key)]).drop("__bits")


def skip_order(rows: DataFrame, epoch: Column, every: int, offset: int) -> DataFrame:
    """First row of every ``every``-second bucket after shifting the clock by ``offset``."""
    return rows.groupBy(F.floor((epoch + offset) / every).cast("long").alias("bucket")).agg(
        F.min_by("frame_id", F.struct(epoch.alias("t"), F.col("frame_id").alias("f"))).alias("frame_id")
    )


def chunk_queues(order: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each chunk's frames as a queue in the given order, from 0."""
    placed = order.select("frame_id", F.col("pos").alias("__pos")).join(chunks.select("frame_id", "chunk_id"), "frame_id")
    return positions(placed, [F.col("__pos")], by=["chunk_id"]).drop("__pos")


def top_unseen(scored: DataFrame, seen: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Best ``k`` frames not looked at yet (a bounded top-k, not a full sort)."""
    fresh = scored.join(seen.select("frame_id").distinct(), "frame_id", "left_anti")
    return fresh.orderBy(F.col(score).desc(), "frame_id").limit(k)


def sampled_negatives(rows: DataFrame, key: str, label: str, seed, per_positive: int = 2) -> DataFrame:
    """Positives with ``per_positive`` negatives each, drawn with replacement."""
    keyed = rows.withColumn("__k", seed_key(seed, key))
    ranked = running(keyed, [F.col("__k")], hex_bucket(F.col("__k"), 3), by=[label], name="__pos").drop("__k")
    pos, neg = ranked.where(F.col(label) > 0), ranked.where(F.col(label) <= 0)
    n_neg = neg.agg(F.count(F.lit(1))).scalar()
    draw = F.conv(F.substring(seed_key(seed, F.lit("slot"), F.col("slot")), 1, 8), 16, 10).cast("long")
    slots = pos.select(
        F.explode(F.sequence(F.col("__pos") * per_positive, F.col("__pos") * per_positive + per_positive - 1)).alias("slot")
    )
    drawn = slots.withColumn("__pos", draw % n_neg).join(neg, "__pos")
    return pos.withColumn("slot", F.lit(None).cast("long")).drop("__pos").unionByName(drawn.drop("__pos"))


def weighted_order(frames: DataFrame, logit: str, temperatures: Sequence[float], seed) -> DataFrame:
    """Weighted permutation without replacement, weights softmax(logit / T), for several T.

    Sorting by ``ln(-ln u) - logit/T`` draws proportionally to exp(logit/T) at every turn.
    """
    rows = frames.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in temperatures])))
    u = hex_unit(seed_key(seed, F.col("frame_id")))
    keyed = rows.withColumn("__sort", F.log(-F.log(u)) - F.col(logit) / F.col("t"))
    return positions(keyed, [F.col("__sort"), F.col("frame_id")], by=["t"]).select("t", "frame_id", "pos")

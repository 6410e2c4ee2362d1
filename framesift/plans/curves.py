"""Discovery curves: distinct finds against frames looked at, for orders known in advance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.functions.ordinal import block_of, running


def first_finds(order: DataFrame, hits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per (category, track): the position at which it is first seen.

    Duplicates of a hot track fold into one row before the shuffle.
    """
    seen = hits.join(order, "frame_id")
    return seen.groupBy(*by, "category", "track_id").agg(F.min("pos").alias("pos"))


def discovery_curve(order: DataFrame, hits: DataFrame, by: Sequence[str] = (), length: int | None = None) -> DataFrame:
    """(by…, category, nf, ni): distinct objects found once ``nf`` frames have been looked at.

    One row per frame that brings something new.  Equal to looping over the order with a seen
    set, but the loop is a minimum per track and a running sum.
    """
    keys = [*by, "category"]
    news = first_finds(order, hits, by).groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("new"))
    curve = running(news, [F.col("pos")], block_of(F.col("pos"), length), by=keys, value=F.col("new"), name="ni")
    return curve.select(*keys, (F.col("pos") + 1).alias("nf"), "ni")


def graded_history(order: DataFrame, hits: DataFrame, batch: int, total: int, by: Sequence[str] = ()) -> DataFrame:
    """Grader history: start, the state just before and just after each batch with news, and the end.

    ``total`` is the number of frames in the order; rows carry a ``seq`` that keeps their sequence.
    """
    keys = [*by, "category"]
    batched = first_finds(order, hits, by).withColumn("batch", F.floor(F.col("pos") / batch))
    news = batched.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("new"))
    steps = running(news, [F.col("batch")], block_of(F.col("batch"), -(-total // batch)), by=keys, value=F.col("new"), name="ni")
    state = lambda ni, nf, seq: F.struct(ni.cast("long").alias("ni"), nf.cast("long").alias("nf"), seq.cast("long").alias("seq"))
    b = F.col("batch")
    around = steps.select(*keys, F.explode(F.array(
        state(F.col("ni") - F.col("new"), b * batch, 2 * b + 1),
        state(F.col("ni"), F.least((b + 1) * batch, F.lit(total)), 2 * b + 2),
    )).alias("s"))
    last = -(-total // batch)
    ends = steps.groupBy(*keys).agg(F.max("ni").alias("ni")).select(*keys, F.explode(F.array(
        state(F.lit(0), F.lit(0), F.lit(0)), state(F.col("ni"), F.lit(total), F.lit(2 * last + 1)))).alias("s"))
    return around.unionByName(ends).select(*keys, "s.*")


def reject_bad_order(order: DataFrame, excluded: DataFrame) -> DataFrame:
    """Frames an order must not hold: excluded ones and repeats.  Empty when the order is sound."""
    bad = order.join(excluded.select("frame_id"), "frame_id", "left_semi").select("frame_id", F.lit("excluded").alias("why"))
    twice = order.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("frame_id", F.lit("repeated").alias("why"))
    return bad.unionByName(twice)


def compact_history(history: DataFrame, by: Sequence[str]) -> DataFrame:
    """First and last row of every ``ni`` value (twice the same row where there is one)."""
    ends = history.groupBy(*by, "ni").agg(F.min("nf").alias("first"), F.max("nf").alias("last"))
    return ends.select(*by, "ni", F.explode(F.array("first", "last")).alias("nf"))


def result_table(history: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Compacted history with totals and the fractions ni/total and nf/total."""
    return compact_history(history, by).join(totals, "category").withColumns({
        "instance_f": F.col("ni") / F.col("total_ni"),
        "frame_f": F.col("nf") / F.col("total_nf"),
    })

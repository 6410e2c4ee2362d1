"""Exact greedy selection along an axis, spread over blocks.

The sequential rule is "take the best remaining item, drop its neighbours".  An item's fate
depends only on better items in its reach, so each block (with a border of neighbouring rows)
can settle every item whose better neighbours are settled.  Items near the border that hang on
rows the block does not see stay open for the next round.  The best open item is always
settled, so the rounds end, and the result equals the sequential one whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.functions.ordinal import positions, seed_key
from framesift.session import cut_lineage, scratch_path, spread

OPEN, TAKEN, DROPPED = 0, 1, 2


def settle_block(at: np.ndarray, rank: np.ndarray, state: np.ndarray, before: int, after: int,
                 lo: float, hi: float) -> np.ndarray:
    """States after one pass over a block whose rows cover [lo, hi].

    A taken item at ``g`` drops worse items in [g-before, g+after].  ``at`` is sorted.
    """
    state = state.copy()
    for i in np.argsort(rank, kind="stable"):
        if state[i] != OPEN:
            continue
        f = at[i]
        # Items that would drop f lie in [f-after, f+before].
        a, b = np.searchsorted(at, f - after, "left"), np.searchsorted(at, f + before, "right")
        better = rank[a:b] < rank[i]
        near = state[a:b][better]
        if (near == TAKEN).any():
            state[i] = DROPPED
        elif not (near == OPEN).any() and f - after >= lo and f + before <= hi:
            state[i] = TAKEN
    return state


def greedy_along(items: DataFrame, axis: str, rank: str, before: int, after: int, by: Sequence[str] = (),
                 block: int = 65536) -> DataFrame:
    """Items with a boolean ``taken``: greedy by ascending unique ``rank`` inside each ``by`` key.

    ``axis`` is an integer; a block holds at most the items of ``block`` + 2·border axis values.
    """
    reach = max(before, after, 1)
    block = max(block, 4 * reach)
    border = max(2 * reach, min(block // 4, 32 * reach))
    by = list(by)
    state = items.withColumn("__state", F.lit(OPEN))
    shift = 0
    out = T.StructType([*items.schema.fields, T.StructField("__state", T.IntegerType())])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(axis, kind="stable")
        at = pdf[axis].to_numpy()
        lo = pdf["__lo"].iloc[0]
        got = settle_block(at, pdf[rank].to_numpy(), pdf["__state"].to_numpy(), before, after, lo - border, lo + block - 1 + border)
        own = (at >= lo) & (at < lo + block)
        return pdf.assign(__state=got.astype("int32"))[own][[f.name for f in out.fields]]

    while True:
        a = F.col(axis) + shift
        first, last = F.floor((a - border) / block), F.floor((a + border) / block)
        copies = state.withColumn("__block", F.explode(F.sequence(first, last))).withColumn("__lo", F.col("__block") * block - shift)
        state = cut_lineage(spread(copies, *by, "__block").groupBy(*by, "__block").applyInPandas(settle, out), "greedy")
        if state.where(F.col("__state") == OPEN).isEmpty():
            return state.withColumn("taken", F.col("__state") == TAKEN).drop("__state")
        shift = (shift + block // 2) % block


def spaced_score_order(scores: DataFrame, excluded: DataFrame, score: str = "score", distance: int = 32, seed=0,
                       block: int = 65536) -> DataFrame:
    """Best score first, no two within the distance; then halve the distance for what is left, down to 0.

    A pick at ``l`` bars [l-d, l+d).  Excluded frames are neither listed nor bar anything.
    """
    left = scores.join(excluded.select("frame_id"), "frame_id", "left_anti").select("frame_id", score)
    ranked = positions(left.withColumn("__key", seed_key(seed, "frame_id")), [-F.col(score), F.col("__key"), F.col("frame_id")], name="__rank")
    left = cut_lineage(ranked.select("frame_id", score, "__rank"), "spaced")
    levels, level, d = [], 0, distance
    while not left.isEmpty():
        if d == 0:
            levels.append(left.withColumn("level", F.lit(level)))
            break
        done = greedy_along(left, "frame_id", "__rank", d, d - 1, block=block)
        levels.append(done.where("taken").drop("taken").withColumn("level", F.lit(level)))
        left = done.where(~F.col("taken")).drop("taken")
        d, level = d // 2, level + 1
    whole = levels[0]
    for part in levels[1:]:
        whole = whole.unionByName(part)
    return positions(whole, [F.col("level"), F.col("__rank")]).drop("__rank")


def grade_events(order: DataFrame, boxes: DataFrame, at_least: int, gap: int, by: Sequence[str] = ("category",),
                 block: int = 65536) -> tuple[DataFrame, DataFrame]:
    """Events of a sampled order: frames with at least ``at_least`` rows, no two within ``gap``.

    Returns the accepted events (by…, event_id, pos) and, for every sampled frame near accepted
    ones, the events it repeats (by…, frame_id, event_id).  Acceptance is greedy in sample order.
    """
    by = list(by)
    counts = boxes.groupBy(*by, "frame_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    quals = counts.join(order, "frame_id").select(*by, "frame_id", "pos")
    done = greedy_along(quals, "frame_id", "pos", gap, gap, by=by, block=block)
    events = done.where("taken").select(*by, F.col("frame_id").alias("event_id"), "pos")
    # A frame has at most two accepted events in reach, and two blocks cover the reach.
    width = 2 * gap + 1
    spots = events.withColumnRenamed("pos", "event_pos").withColumn(
        "__b", F.explode(F.sequence(F.floor((F.col("event_id") - gap) / width), F.floor((F.col("event_id") + gap) / width))))
    sampled = order.select("frame_id", "pos").withColumn("__b", F.floor(F.col("frame_id") / width))
    repeats = sampled.join(spots, "__b").where(
        (F.abs(F.col("frame_id") - F.col("event_id")) <= gap) & (F.col("event_pos") < F.col("pos")))
    return events, repeats.select(*by, "frame_id", "pos", "event_id")


def event_history(events: DataFrame, length: int, by: Sequence[str] = ("category",)) -> DataFrame:
    """(by…, nf, ni) right after every accepted event, with the start row and the end row."""
    from framesift.functions.ordinal import block_of, running

    by = list(by)
    steps = running(events, [F.col("pos")], block_of(F.col("pos"), length), by=by, value=F.lit(1), name="ni")
    ends = steps.groupBy(*by).agg(F.max("ni").alias("m")).select(*by, F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("nf"), F.lit(0).cast("long").alias("ni")),
        F.struct(F.lit(length).cast("long").alias("nf"), F.col("m").alias("ni")))))
    return steps.select(*by, (F.col("pos") + 1).alias("nf"), "ni").unionByName(ends)


def gap_order(scores: DataFrame, positives: DataFrame, score: str = "score", gap: int = 1, seed=0,
              block: int = 65536) -> DataFrame:
    """Score order that puts off frames near positives: frames within ``gap``-1 of a positive taken
    in this pass wait for the next one.

    Feedback comes after every frame, so a pass is a greedy selection in which only positive picks
    drop neighbours.  Frames put off keep their order.  Ends when every frame is listed.
    """
    keyed = scores.withColumn("__key", seed_key(seed, "frame_id"))
    ranked = positions(keyed, [-F.col(score), F.col("__key"), F.col("frame_id")], name="__rank").drop("__key")
    flags = positives.select("frame_id").distinct().withColumn("positive", F.lit(True))
    left = cut_lineage(ranked.join(flags, "frame_id", "left").fillna(False, ["positive"]), "gap")
    spark, number = scores.sparkSession, 0
    path = scratch_path(spark, "passes")
    while not left.isEmpty():
        pos = left.where("positive")
        if gap > 1:
            pos = greedy_along(pos, "frame_id", "__rank", gap - 1, gap - 1, block=block).where("taken")
        if gap > 1:
            # A frame waits if a taken positive with a better rank lies in its reach; blocks twice the reach.
            width = 2 * gap
            marks = pos.select(F.col("frame_id").alias("__p"), F.col("__rank").alias("__prank")).withColumn(
                "__b", F.explode(F.sequence(F.floor((F.col("__p") - gap + 1) / width), F.floor((F.col("__p") + gap - 1) / width))))
            waits = left.withColumn("__b", F.floor(F.col("frame_id") / width)).join(marks, "__b").where(
                (F.abs(F.col("frame_id") - F.col("__p")) < gap) & (F.col("__prank") < F.col("__rank"))).select("frame_id").distinct()
            waits = cut_lineage(waits, "waits")
            now, left = left.join(waits, "frame_id", "left_anti"), cut_lineage(left.join(waits, "frame_id", "left_semi"), "gap")
        else:
            now, left = left, left.limit(0)
        now.withColumn("pass", F.lit(number)).write.mode("append").parquet(path)
        number += 1
    whole = spark.read.parquet(path)
    return positions(whole, [F.col("pass"), F.col("__rank")]).drop("__rank")

"""Operators on detection boxes: quality filters, suppression, matching, grids and masks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.functions import boxes as B
from framesift.functions.ordinal import exact_quantiles
from framesift.operators.greedy import DROPPED, OPEN, TAKEN
from framesift.session import cut_lineage, spread


def confident(df: DataFrame, above: float = 0.5) -> DataFrame:
    return df.where(F.col("confidence") > above)


def box_shapes(df: DataFrame) -> DataFrame:
    """Width, height, ratio height/width and area."""
    x1, y1, x2, y2 = B.box()
    w, h = x2 - x1, y2 - y1
    return df.withColumns({"width": w, "height": h, "ratio": h / w, "area": h * w})


def blacklist_iou(df: DataFrame, blacklist: Sequence[tuple[float, float, float, float]]) -> DataFrame:
    """One row per box and blacklisted box with their IoU; the list is a short constant."""
    listed = F.array(*[F.struct(F.lit(i).alias("bad_id"), *[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b)])
                       for i, b in enumerate(blacklist)])
    rows = df.withColumn("__bad", F.explode(listed))
    bad = tuple(F.col(f"__bad.{n}") for n in ("x1", "y1", "x2", "y2"))
    return rows.select(*df.columns, F.col("__bad.bad_id").alias("bad_id"), B.iou(B.box(), bad).alias("iou"))


def filter_tracks(df: DataFrame, label: str, rows_above: int = 2, ratio: tuple[float, float] = (0.1, float("inf")),
                  width_above: float = 0.0, height_above: float = 0.0,
                  bad_boxes: Sequence[tuple[tuple[float, float, float, float], float]] = ()) -> DataFrame:
    """Boxes of tracks of one label that are long enough and whose median shape passes the bounds.

    ``bad_boxes`` are (box, limit): the median IoU of the track with the box must stay below it.
    """
    mine = box_shapes(df.where((F.col("category") == label) & F.col("track_id").isNotNull()))
    sizes = mine.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_above)
    metric = lambda n, c: F.struct(F.lit(n).alias("m"), c.cast("double").alias("v"))
    cols = [metric("height", F.col("height")), metric("width", F.col("width")), metric("ratio", F.col("ratio"))]
    cols += [metric(f"bad{i}", B.iou(B.box(), tuple(F.lit(float(v)) for v in b))) for i, (b, _) in enumerate(bad_boxes)]
    med = exact_quantiles(mine.select("track_id", F.inline(F.array(*cols))), "v", [0.5], by=["track_id", "m"])
    bounds = {"height": (height_above, float("inf")), "width": (width_above, float("inf")), "ratio": ratio}
    v = F.col("value")
    fails = F.lit(False)
    for name, (lo, hi) in bounds.items():
        bad = ~(v > lo) if hi == float("inf") and name != "ratio" else ~((v > lo) & (v < hi))
        fails = fails | ((F.col("m") == name) & bad)
    for i, (_, limit) in enumerate(bad_boxes):
        fails = fails | ((F.col("m") == f"bad{i}") & ~(v < limit))
    rejected = med.where(fails).select("track_id").distinct()
    good = sizes.select("track_id").join(rejected, "track_id", "left_anti")
    return mine.join(good, "track_id", "left_semi")


def settle_boxes(group: np.ndarray, xy: np.ndarray, rank: np.ndarray, state: np.ndarray, seen: np.ndarray, limit: float) -> np.ndarray:
    """States of boxes after one greedy pass; ``seen`` marks boxes whose whole reach is visible."""
    state = state.copy()
    live: dict[int, list[int]] = {}
    for i in np.argsort(rank, kind="stable"):
        if state[i] == DROPPED:
            continue
        near = live.setdefault(group[i], [])
        if state[i] == OPEN:
            hit = np.array(near, dtype=int)
            if len(near):
                hit = hit[B.np_iou(xy[i:i + 1], xy[hit])[0] > limit]
            if (state[hit] == TAKEN).any():
                state[i] = DROPPED
                continue
            if len(hit) == 0 and seen[i]:
                state[i] = TAKEN
        near.append(i)
    return state


def suppress(df: DataFrame, limit: float, score: str = "confidence", by: Sequence[str] = ("frame_id", "category"),
             key: str = "event_id", rows_per_group: int = 20000) -> DataFrame:
    """Greedy suppression inside each ``by`` key: best score first, drop boxes with IoU above the limit.

    Adds boolean ``kept``.  Same-place boxes fold first; then tasks get tiles of the x axis, with a
    border as wide as the widest box, so one crowded key is spread over many tasks.
    """
    by = list(by)
    x1, y1, x2, y2 = B.CORNERS
    lead = F.min_by(key, F.struct((-F.col(score)).alias("s"), F.col(key)))
    places = df.groupBy(*by, *B.CORNERS).agg(F.max(score).alias("__score"), lead.alias("__lead"))
    places = places.withColumn("__state", F.lit(OPEN))
    size = places.agg(F.count(F.lit(1)), F.max(F.col(x2) - F.col(x1))).first()
    border = float(max(size[1] or 0.0, 1.0))
    tile, groups = 4 * border, max(8, size[0] // rows_per_group)
    out = T.StructType([f for f in places.schema.fields])
    names = [f.name for f in out.fields]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__score", "__lead"], ascending=[False, True]).reset_index(drop=True)
        lo = pdf["__lo"].iloc[0]
        xy = pdf[list(B.CORNERS)].to_numpy()
        group = pdf.groupby(by, sort=False).ngroup().to_numpy()
        seen = (xy[:, 0] >= lo - border) & (xy[:, 2] <= lo + tile + border)
        got = settle_boxes(group, xy, np.arange(len(pdf)), pdf["__state"].to_numpy(), seen, limit)
        own = (xy[:, 0] >= lo) & (xy[:, 0] < lo + tile)
        return pdf.assign(__state=got.astype("int32"))[own][names]

    state, shift = places, 0.0
    while True:
        first = F.floor((F.col(x1) + shift - border) / tile)
        last = F.floor((F.col(x2) + shift + border) / tile)
        tiles = state.withColumn("__tile", F.explode(F.sequence(first, last))).withColumn("__lo", F.col("__tile") * tile - shift)
        tiles = tiles.withColumn("__g", F.pmod(F.xxhash64(*by), F.lit(groups)))
        state = cut_lineage(spread(tiles, "__g", "__tile").groupBy("__g", "__tile").applyInPandas(settle, out), "suppress")
        if state.where(F.col("__state") == OPEN).isEmpty():
            break
        shift = (shift + tile / 2) % tile
    winners = state.where(F.col("__state") == TAKEN).select(F.col("__lead").alias(key), F.lit(True).alias("kept"))
    return df.join(winners, key, "left").fillna(False, ["kept"])


def best_overlaps(left: DataFrame, right: DataFrame, by: Sequence[str], left_key: str, right_score: str,
                  above: float, tile: float = 256.0, rows_per_group: int = 20000) -> DataFrame:
    """Per left box: its best IoU with any right box of the same key, and the best score among right boxes
    whose IoU is above the limit (0 when there is none).

    Both sides are cut into x tiles and meet tile by tile; only one row per (box, tile) leaves a task.
    """
    by = list(by)
    schema = T.StructType([left.schema[left_key], T.StructField("best_iou", T.DoubleType()), T.StructField("best_score", T.DoubleType())])
    x1, _, x2, _ = B.CORNERS

    key_type = left.schema[left_key].dataType
    zero = F.lit(0).cast(key_type)
    side = lambda df, ours, k, s: df.select(
        *by, *B.CORNERS, F.lit(ours).alias("__ours"), k.alias("__key"), s.cast("double").alias("__score"))
    both = side(left, True, F.col(left_key), F.lit(0.0)).unionByName(side(right, False, zero, F.col(right_score)))
    groups = max(8, left.count() // rows_per_group)
    tiles = both.withColumn("__tile", F.explode(F.sequence(F.floor(F.col(x1) / tile), F.floor(F.col(x2) / tile))))
    tiles = tiles.withColumn("__g", F.pmod(F.xxhash64(*by), F.lit(groups)))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        xy, scores = rows[list(B.CORNERS)].to_numpy(), rows["__score"].to_numpy()
        ours = rows["__ours"].to_numpy()
        best, score = np.zeros(len(rows)), np.zeros(len(rows))
        for members in rows.groupby(by, sort=False).indices.values():
            mine, pool = members[ours[members]], members[~ours[members]]
            if not len(mine) or not len(pool):
                continue
            for part in np.array_split(mine, len(mine) * len(pool) // 4_000_000 + 1):
                i = B.np_iou(xy[part], xy[pool])
                best[part] = i.max(axis=1)
                score[part] = np.where(i > above, scores[pool][None, :], 0.0).max(axis=1)
        return pd.DataFrame({left_key: rows["__key"], "best_iou": best, "best_score": score})[ours]

    met = spread(tiles, "__g", "__tile").groupBy("__g", "__tile").applyInPandas(meet, schema)
    return met.groupBy(left_key).agg(F.max("best_iou").alias("best_iou"), F.max("best_score").alias("best_score"))


def near_pairs(new: DataFrame, old: DataFrame, by: Sequence[str], key: str, back: int, iou_at_least: float,
               tile: float = 64.0, least_gap: int = 1) -> DataFrame:
    """Range join: boxes against boxes of the previous ``back`` frames, same key, IoU at least the limit (above 0).

    With ``least_gap`` 0 boxes of the same frame meet too, themselves included.

    Equi-join on (key, frame block, tile of the plane); the older side is copied to the blocks it can
    meet.  Only boxes that share a tile meet, and a pair is kept in the tile where its overlap
    starts, so no distinct is needed.
    """
    by = list(by)
    width = back + 1
    x1, y1, x2, y2 = (F.col(c) for c in B.CORNERS)
    cover = lambda a, b: F.explode(F.sequence(F.floor(a / tile), F.floor(b / tile)))

    def tiled(df, side):
        named = [F.col(c).alias(f"{side[0]}_{c}") for c in B.CORNERS]
        spread_x = df.withColumn("__x", cover(x1, x2)).withColumn("__y", cover(y1, y2))
        return spread_x.select(*by, F.col(key).alias(f"{side}_id"), F.col("frame_id").alias(f"{side}_frame"), *named, "__x", "__y")

    n = tiled(new, "new").withColumn("__b", F.floor(F.col("new_frame") / width))
    at = F.floor(F.col("old_frame") / width)
    o = tiled(old, "old").withColumn("__b", F.explode(F.array(at, at + 1)))
    gap = F.col("new_frame") - F.col("old_frame")
    starts = (F.floor(F.greatest("n_xmin", "o_xmin") / tile) == F.col("__x")) & (F.floor(F.greatest("n_ymin", "o_ymin") / tile) == F.col("__y"))
    # Packed files of boxes look small; the tiled rows made from them are many times as large, so none are broadcast.
    met = n.join(o.hint("merge"), [*by, "__b", "__x", "__y"]).where((gap >= least_gap) & (gap <= back) & starts)
    overlap = B.iou(B.box("n_"), B.box("o_"))
    return met.withColumn("iou", overlap).where(F.col("iou") >= iou_at_least).select(*by, "new_id", "new_frame", "old_id", "old_frame", "iou")


def grid_cells(df: DataFrame, cell: float, width: int, height: int, keys: Sequence[str]) -> DataFrame:
    """Distinct grid cells (i row, j column) every box covers, clipped to the grid."""
    x1, y1, x2, y2 = B.box()
    nw, nh = -(-width // cell), -(-height // cell)
    # Like an array slice: the end is exclusive and both ends are cut at the grid.
    span = lambda a, b, n: (F.greatest(F.floor(a / cell), F.lit(0)), F.least(F.floor((b + cell - 1) / cell), F.lit(int(n))) - 1)
    (j0, j1), (i0, i1) = span(x1, x2, nw), span(y1, y2, nh)
    rows = df.select(*keys, i0.alias("i0"), i1.alias("i1"), j0.alias("j0"), j1.alias("j1")).where((F.col("i0") <= F.col("i1")) & (F.col("j0") <= F.col("j1")))
    rows = rows.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("j", F.explode(F.sequence("j0", "j1")))
    return rows.select(*keys, "i", "j").distinct()


def line_cells(df: DataFrame, cell: float, keys: Sequence[str]) -> DataFrame:
    """Distinct grid cells a segment (x1, y1)–(x2, y2) passes.

    Sloped segments: crossings with the grid lines, x and y lists sorted on their own, rounded to
    two places in cell units and floored, kept inside the segment's cell range.  Segments inside
    one row or column of cells list the cells in between.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    lo = lambda a, b: F.floor(F.least(a, b) / cell)
    hi = lambda a, b: F.floor(F.greatest(a, b) / cell)
    rows = df.select(*keys, "x1", "y1", "x2", "y2", lo(x1, x2).alias("j0"), hi(x1, x2).alias("j1"), lo(y1, y2).alias("i0"), hi(y1, y2).alias("i1"))
    sloped = (F.col("j0") < F.col("j1")) & (F.col("i0") < F.col("i1"))
    xs, ys = F.sequence("j0", "j1"), F.sequence("i0", "i1")
    x_at = F.transform(xs, lambda j: j * F.lit(float(cell)))
    y_at = F.transform(ys, lambda i: i * F.lit(float(cell)))
    share_x = lambda x: (x - x2) / (x1 - x2)
    share_y = lambda y: (y - y2) / (y1 - y2)
    px = F.array_sort(F.concat(x_at, F.transform(y_at, lambda y: share_y(y) * x1 + (1 - share_y(y)) * x2)))
    py = F.array_sort(F.concat(F.transform(x_at, lambda x: share_x(x) * y1 + (1 - share_x(x)) * y2), y_at))
    to_cell = lambda v: F.abs(F.floor(F.rint(v / cell * 100) / 100))
    cross = F.zip_with(px, py, lambda x, y: F.struct(to_cell(y).cast("long").alias("i"), to_cell(x).cast("long").alias("j")))
    inside = F.filter(cross, lambda c: c["j"].between(F.col("j0"), F.col("j1")) & c["i"].between(F.col("i0"), F.col("i1")))
    straight = F.when(F.col("j0") == F.col("j1"), F.transform(ys, lambda i: F.struct(i.alias("i"), F.col("j0").alias("j")))).otherwise(
        F.transform(xs, lambda j: F.struct(F.col("i0").alias("i"), j.alias("j"))))
    cells = F.when(sloped, inside).otherwise(straight)
    return rows.select(*keys, F.inline(cells)).distinct()


def category_masks(cells: DataFrame, image: str, categories: Sequence[str]) -> DataFrame:
    """0/1 per category for every (image, cell) any category covers."""
    return cells.groupBy(image, "i", "j").agg(*[
        F.coalesce(F.max((F.col("category") == c).cast("int")), F.lit(0)).alias(c) for c in categories])


def composite_mask(masks: DataFrame, part: str, parents: Sequence[str], whole: str) -> DataFrame:
    """The part, the OR of two other masks, and the whole, beside each other."""
    either = F.greatest(*[F.col(c) for c in parents])
    return masks.select(*[c for c in masks.columns if c not in (part, *parents, whole)],
                        F.col(part), (either > 0).cast("int").alias("_or_".join(parents)), F.col(whole))


def encode_boxes(df: DataFrame, image: str, cell: float, box_w: float, box_h: float, order: str) -> DataFrame:
    """Grid code of boxes: cell of the centre, position in it, log size; the last box of a cell wins."""
    x1, y1, x2, y2 = B.box()
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    code = F.struct(((cx % cell) / cell).alias("rel_x"), ((cy % cell) / cell).alias("rel_y"),
                    F.log((x2 - x1) / box_w).alias("rel_w"), F.log((y2 - y1) / box_h).alias("rel_h"))
    rows = df.select(image, F.floor(cy / cell).alias("i"), F.floor(cx / cell).alias("j"), F.col(order).alias("__o"), code.alias("code"))
    return rows.groupBy(image, "i", "j").agg(F.max_by("code", "__o").alias("code")).select(image, "i", "j", "code.*")


def decode_boxes(df: DataFrame, cell: float, box_w: float, box_h: float) -> DataFrame:
    """Corner boxes of grid codes; log sizes are clamped at 8."""
    w = F.exp(F.least(F.col("rel_w"), F.lit(8.0))) * box_w
    h = F.exp(F.least(F.col("rel_h"), F.lit(8.0))) * box_h
    cx, cy = (F.col("j") + F.col("rel_x")) * cell, (F.col("i") + F.col("rel_y")) * cell
    corners = dict(zip(B.CORNERS, B.from_center(cx, cy, w, h)))
    return df.withColumns(corners)


def proposals(decoded: DataFrame, score: str, score_above: float, iou_limit: float, by: Sequence[str], key: str,
              logits: bool = False) -> DataFrame:
    """Decoded boxes above the score that survive suppression."""
    s = 1 / (1 + F.exp(-F.col(score))) if logits else F.col(score)
    passed = decoded.withColumn(score, s).where(F.col(score) > score_above)
    return suppress(passed, iou_limit, score, by, key).where("kept").drop("kept")


# Fixed values: (frames whose difference counts, small model score that counts) of the preset modes;
# None stands for the thresholds measured for the data set.
CASCADE_MODES: Mapping[str, tuple[float | None, float | None]] = {
    "diff": (float("inf"), float("inf")),
    "diff_small": (-1.0, float("inf")),
    "everything": (-1.0, -1.0),
    "measured": (None, None),
}


def cascade(df: DataFrame, mode: str, diff: Column, small: Column, detector: Column,
            measured: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Cheap-to-expensive predicates: a stage's score counts only if the stage before passed its threshold.

    ``status`` is 2, 4 or 6 for the last stage reached.
    """
    over_diff, over_small = (m if m is not None else d for m, d in zip(CASCADE_MODES[mode], measured))
    return _judged(df, diff, small, detector, F.lit(over_diff), F.lit(over_small))


def _judged(df: DataFrame, diff: Column, small: Column, detector: Column, over_diff: Column, over_small: Column) -> DataFrame:
    second = diff > over_diff
    third = second & (small > over_small)
    return df.withColumns({
        "status": F.when(third, 6).when(second, 4).otherwise(2),
        "diff_score": diff,
        "small_score": F.when(second, small).otherwise(F.lit(0.0)),
        "detector_score": F.when(third, detector).otherwise(F.lit(0.0)),
    })


def cascades(df: DataFrame, modes: Iterable[str], diff: Column, small: Column, detector: Column,
             measured: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``cascade`` in several modes, named by ``mode``, in one pass over ``df``."""
    rows = df.withColumns({"__diff": diff, "__small": small, "__detector": detector})
    over = lambda at: F.element_at(F.create_map(*[F.lit(x) for m in modes for x in (m, measured[at] if CASCADE_MODES[m][at] is None else CASCADE_MODES[m][at])]), F.col("mode"))
    rows = rows.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).withColumns({"__over_diff": over(0), "__over_small": over(1)})
    return _judged(rows, F.col("__diff"), F.col("__small"), F.col("__detector"), F.col("__over_diff"), F.col("__over_small")).drop(
        "__diff", "__small", "__detector", "__over_diff", "__over_small")


def cascade_share(df: DataFrame) -> DataFrame:
    """Frames and percent per status."""
    counts = df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100 / counts.agg(F.sum("n")).scalar())


def label_combinations(counts: DataFrame, a: str, b: str, sizes: Mapping[str, int], seed, key: str) -> DataFrame:
    """Random rows of each kind: ``alone`` (a without b), ``paired`` (as many b as a), ``neither``."""
    from framesift.functions.ordinal import seed_key

    ca, cb = F.col(a), F.col(b)
    kinds = {"alone": (ca > 0) & (cb < 1), "paired": (ca > 0) & (ca == cb), "neither": (ca < 1) & (cb < 1)}
    parts = [counts.where(kinds[k]).orderBy(seed_key(seed, key), key).limit(n).withColumn("kind", F.lit(k)) for k, n in sizes.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole

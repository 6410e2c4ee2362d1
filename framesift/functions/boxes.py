"""Box arithmetic as column expressions.  A box is four doubles: x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]
CORNERS = ("xmin", "ymin", "xmax", "ymax")


def box(prefix: str = "", names: Sequence[str] = CORNERS) -> Box:
    return tuple(F.col(prefix + n) for n in names)


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    return area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def iou(a: Box, b: Box) -> Column:
    inner = intersection(a, b)
    return inner / (area(a) + area(b) - inner)


def giou(a: Box, b: Box) -> Column:
    """IoU minus the share of the enclosing box that neither covers."""
    inner = intersection(a, b)
    union = area(a) + area(b) - inner
    hull = area((F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])))
    return inner / union - (hull - union) / hull


def from_center(cx: Column, cy: Column, w: Column, h: Column, width=1.0, height=1.0) -> Box:
    """Corner box of a centre/size box, scaled to an image."""
    return ((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def best_class(logits: Column) -> tuple[Column, Column]:
    """(class, probability) of the best class after softmax; the last entry is background."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    real = F.slice(powers, 1, F.size(logits) - 1)
    best = F.array_max(real)
    return (F.array_position(real, best) - 1).cast("int"), best / total


def np_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of every box of ``a`` (n×4) with every box of ``b`` (m×4), for use inside a task."""
    side = lambda lo, hi: np.clip(np.minimum(a[:, None, hi], b[:, hi]) - np.maximum(a[:, None, lo], b[:, lo]), 0, None)
    inner = side(0, 2) * side(1, 3)
    size = lambda x: np.prod(np.clip(x[:, 2:] - x[:, :2], 0, None), axis=1)
    union = size(a)[:, None] + size(b)[None, :] - inner
    return np.divide(inner, union, out=np.zeros_like(inner), where=union > 0)


#: Pairs of boxes that are compared in one matrix, and at once where boxes are looked up.
DENSE, AT_ONCE = 1 << 14, 1 << 16


def overlaps(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, IoU) of the pairs of a box of ``a`` and one of ``b`` that overlap, by at least ``least``; in order of i, then j.

    The boxes of ``b`` lie in strips, by their left edge; a box of ``a`` meets those that can reach it, not all.
    """
    if len(a) * len(b) <= DENSE:
        iou = np_iou(a, b)
        i, j = np.nonzero((iou > 0) & (iou >= least))
        return i, j, iou[i, j]
    rows, others = np.flatnonzero(np.isfinite(a).all(axis=1)), np.flatnonzero(np.isfinite(b).all(axis=1))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(rows) or not len(others):
        return none
    x1, y1, x2, y2 = a[rows].T
    left, low = b[others, 0], b[others, 1]
    reach, rise = ((b[others, k + 2] - b[others, k]).max() for k in (0, 1))
    # An overlap of this share leaves the rest of either side to lie outside.
    rest = 1.0 - min(max(least, 0.0), 1.0)
    reach, rise = max(reach, 0.0) * rest, max(rise, 0.0) * rest
    strip = max(rise, (y2 - y1).max() * rest) / 2 or 1.0
    of = np.floor((low - low.min()) / strip)
    width = left.max() - left.min() + 2.0
    spare = 1e-9 * (width + np.abs(a[rows]).max() + np.abs(b[others]).max())  # the keys are rounded; pairs are decided on the boxes
    key = of * (width + 4 * spare) + (left - left.min())
    order = np.argsort(key, kind="stable")
    key = key[order]
    top = of.max()
    lo, hi = (np.clip(x - left.min(), -1.0, width - 1) for x in (x1 - reach, x1 + (x2 - x1) * rest))
    first, last = (np.clip(np.floor((y - low.min() + pad) / strip), -1, top + 1) for y, pad in ((y1 - rise, -spare), (y1 + (y2 - y1) * rest, spare)))
    owner, begin, count = [], [], []
    for k in range(int((last - first).max(initial=-1)) + 1):
        at = np.flatnonzero((first + k <= last) & (first + k >= 0) & (first + k <= top))
        base = (first[at] + k) * (width + 4 * spare)
        s, e = np.searchsorted(key, base + lo[at] - spare), np.searchsorted(key, base + hi[at] + spare, "right")
        owner.append(at)
        begin.append(s)
        count.append(np.maximum(e - s, 0))
    owner, begin, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, begin, count))
    found, ends, at = [none], np.cumsum(count), 0
    size = lambda x: np.clip(x[:, 2] - x[:, 0], 0, None) * np.clip(x[:, 3] - x[:, 1], 0, None)
    one, two = (np.ascontiguousarray(np.column_stack([x, size(x)]).T) for x in (a[rows], b[others[order]]))
    while at < len(owner):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        n = count[at:end]
        i = np.repeat(owner[at:end], n)
        j = np.repeat(begin[at:end] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = end
        side = lambda lo, hi: np.minimum(one[hi][i], two[hi][j]) - np.maximum(one[lo][i], two[lo][j])
        tall = side(1, 3)
        hit = np.flatnonzero(tall > 0)
        i, j, tall = i[hit], j[hit], tall[hit]
        inner = np.clip(side(0, 2), 0, None) * tall
        hit = np.flatnonzero(inner > 0)
        i, j, inner = i[hit], j[hit], inner[hit]
        iou = inner / (one[4][i] + two[4][j] - inner)
        kept = iou >= least
        found.append((rows[i[kept]], others[order[j[kept]]], iou[kept]))
    i, j, iou = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort([j, i])
    return i[order], j[order], iou[order]

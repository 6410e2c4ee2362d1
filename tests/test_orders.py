import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.operators import greedy, orders, prep
from framesift.plans import curves


def halving(size, step, offset):
    """Iterative twin: level of every frame."""
    step, level, out = max(1, min(step, size // 4)), 0, {}
    while step >= 1:
        offset %= step
        for f in range(offset, size, step):
            out.setdefault(f, level)
        step, level = step // 2, level + 1
    return out


@pytest.mark.parametrize("size,step,offset", [(10, 2, 1), (97, 256, 5), (1000, 256, 200), (4, 1, 0), (513, 37, 36)])
def test_stride_levels(spark, size, step, offset):
    frames = spark.range(size).withColumnRenamed("id", "frame_id")
    got = orders.stride_halving_order(frames, size, initial_step=step, initial_offset=offset).collect()
    assert {r.frame_id: r.level for r in got} == halving(size, step, offset)
    assert sorted(r.pos for r in got) == list(range(size))
    by_pos = [r.level for r in sorted(got, key=lambda r: r.pos)]
    assert by_pos == sorted(by_pos)


def test_batches_skip_excluded(spark):
    order = orders.random_order(spark.range(200).withColumnRenamed("id", "frame_id"), 3)
    bad = spark.range(50).withColumnRenamed("id", "frame_id")
    seen = [r.frame_id for s in range(0, 200, 40) for r in orders.next_batch(order, s, 40, bad).orderBy("pos").collect()]
    assert sorted(seen) == list(range(50, 200))
    want = [r.frame_id for r in order.orderBy("pos").collect() if r.frame_id >= 50]
    assert seen == want


def md5(i):
    return hashlib.md5(f"0:{i}".encode()).hexdigest()


@pytest.mark.parametrize("kind", ["random", "ties", "rising"])
def test_spaced_order_equals_sequential(spark, kind):
    n, rng = 300, np.random.default_rng(1)
    score = {"random": rng.random(n), "ties": rng.integers(0, 3, n) * 1.0, "rising": np.arange(n) / n}[kind]
    out_of = set(rng.choice(n, 40, replace=False).tolist()) | {0, n - 1}
    df = spark.createDataFrame([(i, float(score[i])) for i in range(n)], "frame_id long, score double")
    bad = spark.createDataFrame([(int(i),) for i in out_of], "frame_id long")
    got = [r.frame_id for r in greedy.spaced_score_order(df, bad, distance=4, block=64).orderBy("pos").collect()]
    seen, want, d = set(), [], 4
    while len(seen) < n - len(out_of):
        banned = out_of | seen
        for f in sorted(set(range(n)) - banned, key=lambda i: (-score[i], md5(i))):
            if f not in banned:
                want.append(f)
                seen.add(f)
                banned |= set(range(max(0, f - d), f + d))
        d //= 2
    assert got == want


def gap_twin(score, positive, gap):
    queue = sorted(range(len(score)), key=lambda i: (-score[i], md5(i)))
    out = []
    while queue:
        wait, delayed = [], set()
        for f in queue:
            if f in delayed:
                wait.append(f)
                continue
            out.append(f)
            if positive[f]:
                delayed |= set(range(f - gap + 1, f + gap))
        queue = wait
    return out


def test_gap_order_equals_sequential(spark):
    n, rng = 200, np.random.default_rng(2)
    score, positive = rng.integers(0, 5, n) * 1.0, rng.random(n) < 0.4
    df = spark.createDataFrame([(i, float(score[i])) for i in range(n)], "frame_id long, score double")
    pos = spark.createDataFrame([(int(i),) for i in np.flatnonzero(positive)], "frame_id long")
    for gap in (1, 3):
        got = [r.frame_id for r in greedy.gap_order(df, pos, gap=gap, block=64).orderBy("pos").collect()]
        assert got == gap_twin(score, positive, gap)


def test_gap_order_walks_the_axis(spark):
    df = spark.range(100).select(F.col("id").alias("frame_id"), (1 - F.col("id") / 100).alias("score"))
    got = [r.frame_id for r in greedy.gap_order(df, df, gap=20).orderBy("pos").limit(10).collect()]
    assert got == [0, 20, 40, 60, 80, 1, 21, 41, 61, 81]


def test_events_equal_sequential(spark):
    n, gap, rng = 400, 7, np.random.default_rng(3)
    counts = rng.integers(0, 4, n)
    boxes = spark.createDataFrame([("a", int(i)) for i in range(n) for _ in range(counts[i])], "category string, frame_id long")
    perm = rng.permutation(n)
    order = spark.createDataFrame([(int(f), p) for p, f in enumerate(perm)], "frame_id long, pos long")
    events, repeats = greedy.grade_events(order, boxes, 2, gap, block=64)
    want, again = [], set()
    for f in perm.tolist():
        near = [e for e in want if abs(e - f) <= gap]
        again |= {(f, e) for e in near}
        if not near and counts[f] >= 2:
            want.append(f)
    assert [r.event_id for r in events.orderBy("pos").collect()] == want
    assert {(r.frame_id, r.event_id) for r in repeats.collect()} == again


def test_event_gap_edges(spark):
    boxes = spark.createDataFrame([("a", f) for f in (100, 110, 121)], "category string, frame_id long")
    order = spark.createDataFrame([(100, 0), (105, 1), (110, 2), (121, 3)], "frame_id long, pos long")
    events, repeats = greedy.grade_events(order, boxes, 1, 10)
    assert [r.event_id for r in events.orderBy("pos").collect()] == [100, 121]
    assert {(r.frame_id, r.event_id) for r in repeats.collect()} == {(105, 100), (110, 100)}


def test_curve_and_history_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    hits = [(("a", "b")[int(rng.integers(2))], int(rng.integers(120)), int(rng.integers(25))) for _ in range(400)]
    h = spark.createDataFrame(hits, "category string, frame_id long, track_id long")
    perm = rng.permutation(120).tolist()
    order = spark.createDataFrame([(f, p) for p, f in enumerate(perm)], "frame_id long, pos long")
    want, hist = set(), set()
    for c in ("a", "b"):
        of = {f: {t for cc, ff, t in hits if cc == c and ff == f} for f in perm}
        seen = set()
        for p, f in enumerate(perm):
            if of[f] - seen:
                seen |= of[f]
                want.add((c, p + 1, len(seen)))
        seen, rows = set(), [(0, 0)]
        for b in range(0, 120, 50):
            batch = perm[b:b + 50]
            new = set().union(*[of[f] for f in batch]) - seen
            if new:
                rows.append((len(seen), b))
                seen |= new
                rows.append((len(seen), min(b + 50, 120)))
        rows.append((len(seen), 120))
        hist |= {(c, i, *r) for i, r in enumerate(rows)}
    assert {(r.category, r.nf, r.ni) for r in curves.discovery_curve(order, h).collect()} == want
    got = curves.graded_history(order, h, 50, 120).orderBy("category", "seq").collect()
    per = {}
    assert {(r.category, per.setdefault(r.category, []).append(0) or len(per[r.category]) - 1, r.ni, r.nf) for r in got} == hist
    compact = curves.compact_history(curves.graded_history(order, h, 50, 120), ["category"]).where("category = 'a' AND ni = 0").collect()
    assert len(compact) == 2


def test_track_is_kept_in_every_category_if_long_in_one(spark):
    boxes = spark.createDataFrame([("a", 1, f) for f in range(3)] + [("b", 1, f) for f in range(2)] + [("a", 2, f) for f in range(2)],
                                  "category string, track_id long, frame_id long")
    none = spark.createDataFrame([], "frame_id long")
    assert {(r.category, r.track_id) for r in prep.usable_boxes(boxes, none).collect()} == {("a", 1), ("b", 1)}

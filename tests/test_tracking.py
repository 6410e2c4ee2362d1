import itertools

import numpy as np
import pandas as pd
import pytest

from framesift.functions import boxes
from framesift.functions.boxes import np_iou
from framesift.operators import detections as D
from framesift.operators import tracking as K

SCHEMA = "event_id long, category string, frame_id long, xmin double, ymin double, xmax double, ymax double, confidence double"


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        gain = rng.random((n, m)) * (rng.random((n, m)) > 0.4)
        a = gain if n <= m else gain.T
        best = max(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(a.shape[1]), len(a)))
        assert sum(gain[r, c] for r, c in K.best_assignment(gain)) == pytest.approx(best)


def random_boxes(spark, n=400, frames=40, seed=0):
    rng = np.random.default_rng(seed)
    x, y = rng.random(n) * 900, rng.random(n) * 300
    rows = [(i, ("a", "b")[int(rng.integers(2))], int(rng.integers(frames)), float(x[i]), float(y[i]), float(x[i] + 30 + rng.random() * 60),
             float(y[i] + 30 + rng.random() * 60), float(rng.integers(100)) / 100) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


@pytest.mark.parametrize("limit", [0.1, 0.5])
def test_suppression_equals_sequential_in_a_crowded_frame(spark, limit):
    df, pdf = random_boxes(spark, 500, frames=1)
    got = {r.event_id for r in D.suppress(df, limit, by=["frame_id"]).where("kept").collect()}
    kept = []
    for i in pdf.sort_values(["confidence", "event_id"], ascending=[False, True]).index:
        xy = pdf.loc[[i], ["xmin", "ymin", "xmax", "ymax"]].to_numpy()
        if not kept or np_iou(xy, pdf.loc[kept, ["xmin", "ymin", "xmax", "ymax"]].to_numpy()).max() <= limit:
            kept.append(i)
    assert got == set(pdf.loc[kept, "event_id"])


def test_best_overlaps_equal_all_pairs(spark):
    df, pdf = random_boxes(spark, 300, frames=3)
    left, right = df.where("category = 'a'"), df.where("category = 'b'")
    got = {r.event_id: (r.best_iou, r.best_score) for r in D.best_overlaps(left, right, ["frame_id"], "event_id", "confidence", 0.1, tile=50.0).collect()}
    cols = ["xmin", "ymin", "xmax", "ymax"]
    for _, a in pdf[pdf.category == "a"].iterrows():
        b = pdf[(pdf.category == "b") & (pdf.frame_id == a.frame_id)]
        iou = np_iou(a[cols].to_numpy(dtype=float)[None, :], b[cols].to_numpy())[0]
        assert got[a.event_id][0] == pytest.approx(iou.max())
        assert got[a.event_id][1] == pytest.approx(np.where(iou > 0.1, b.confidence, 0).max())


def walk(pdf, rules):
    """Sequential twin with its own bookkeeping."""
    tids, off = {}, {}
    for _, grp in pdf.groupby("category"):
        live = {}
        for frame, rows in grp.sort_values(["frame_id", "event_id"]).groupby("frame_id"):
            live = {t: (b, f) for t, (b, f) in live.items() if not rules.cuts(frame - f)}
            names = list(live)
            xy = rows[["xmin", "ymin", "xmax", "ymax"]].to_numpy()
            iou = np_iou(xy, np.array([live[t][0] for t in names]).reshape(-1, 4))
            iou[iou < rules.iou_min] = 0
            pairs = [(r, c) for r, c in K.best_assignment(iou) if iou[r, c] > 0] if iou.size else []
            match = dict(pairs)
            new = {}
            strength = [1.5 if i in match else c for i, c in enumerate(rows.confidence)]
            kept = []
            for i in sorted(range(len(rows)), key=lambda i: -strength[i]):
                if rules.suppress_above is None or not kept or np_iou(xy[[i]], xy[kept]).max() <= rules.suppress_above:
                    kept.append(i)
            for i, (eid, conf) in enumerate(zip(rows.event_id, rows.confidence)):
                weak = rules.start_above is not None and conf <= rules.start_above
                tids[eid] = names[match[i]] if i in match else eid
                off[eid] = i not in match and (i not in kept or weak)
                if not off[eid]:
                    new[tids[eid]] = (xy[i], frame)
            for _, c in pairs:
                live.pop(names[c])
            live.update(new)
    return tids, off


@pytest.mark.parametrize("rules", [K.SIMPLE, K.Linking(30, 0.01, 0.5, 0.2, True), K.Linking(2, 0.1)])
def test_linker_equals_sequential(spark, rules):
    df, pdf = random_boxes(spark, 500, frames=60, seed=5)
    got = K.link_tracks(df, rules).collect()
    tids, off = walk(pdf, rules)
    assert {r.event_id: r.tid for r in got} == tids
    assert {r.event_id: r.suppressed for r in got} == off


def still(frames):
    return [(i, "a", f, 0.0, 0.0, 10.0, 10.0, 1.0) for i, f in enumerate(frames)]


def test_grace_periods(spark):
    simple = {r.event_id: r.tid for r in K.link_tracks(spark.createDataFrame(still([0, 5, 11]), SCHEMA), K.SIMPLE).collect()}
    assert simple == {0: 0, 1: 0, 2: 2}
    sure = {r.event_id: r.tid for r in K.link_tracks(spark.createDataFrame(still([0, 29, 59]), SCHEMA), K.CONFIDENT).collect()}
    assert sure == {0: 0, 1: 0, 2: 2}


def test_crossing_boxes_keep_their_tracks(spark):
    rows = []
    for f in range(11):
        rows += [(2 * f, "a", f, 10.0 * f, 0.0, 10.0 * f + 40, 40.0, 1.0), (2 * f + 1, "a", f, 100.0 - 10 * f, 12.0, 140.0 - 10 * f, 52.0, 1.0)]
    got = {r.event_id: r.tid for r in K.link_tracks(spark.createDataFrame(rows, SCHEMA), K.SIMPLE).collect()}
    assert all(t == e % 2 for e, t in got.items())


def test_tracks_stay_inside_partitions(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(still(range(10)), SCHEMA).withColumn("part", F.floor(F.col("frame_id") / 5))
    got = {r.event_id: r.tid for r in K.link_tracks(df, K.SIMPLE, partition_by=["part"]).collect()}
    assert set(got.values()) == {0, 5}


def test_of_equal_assignments_the_first_rows_get_the_smallest_columns():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, m = rng.integers(1, 5, 2)
        gain = rng.integers(0, 3, (n, m)) / 2
        ways = []
        for cols in itertools.product(range(m + 1), repeat=n):  # m stands for no column
            used = [c for c in cols if c < m]
            if len(set(used)) == len(used) and all(gain[r, c] > 0 for r, c in enumerate(cols) if c < m):
                ways.append((-sum(gain[r, c] for r, c in enumerate(cols) if c < m), cols))
        best = min(ways)[1]
        assert K.settled_assignment(gain) == [(r, c) for r, c in enumerate(best) if c < m]


def test_equal_boxes_in_a_frame_keep_their_order(spark):
    rows = [(10 * f + k, "a", f, 0.0, 0.0, 10.0, 10.0, 1.0) for f in range(4) for k in range(3)] + [(99, "a", 4, 0.0, 0.0, 10.0, 10.0, 1.0)]
    got = {r.event_id: r.tid for r in K.link_tracks(spark.createDataFrame(rows, SCHEMA), K.SIMPLE).collect()}
    assert got == {**{10 * f + k: k for f in range(4) for k in range(3)}, 99: 0}


def test_one_busy_camera_is_many_components(spark):
    """Sixty objects that never meet, in one stream and category: as many components, none larger than one track."""
    rows = [(100 * f + k, "a", f, 100.0 * (k % 10) + f, 100.0 * (k // 10), 100.0 * (k % 10) + f + 40, 100.0 * (k // 10) + 40, 1.0) for f in range(20) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = K.connected(K.linkable(df, K.SIMPLE, ["category"], "event_id")).groupBy("root").count().collect()
    assert len(sizes) == 60 and {r["count"] for r in sizes} == {20}
    assert all(r.tid == r.event_id % 100 for r in K.link_tracks(df, K.SIMPLE).collect())


def test_linking_nothing_and_lonely_boxes(spark):
    assert K.link_tracks(spark.createDataFrame([], SCHEMA), K.CONFIDENT).count() == 0
    rows = [(1, "a", 0, 0.0, 0.0, 9.0, 9.0, 0.5), (2, "a", 99, 0.0, 0.0, 9.0, 9.0, 1.0), (3, "b", 0, 0.0, 0.0, 9.0, 9.0, None)]
    got = {r.event_id: (r.tid, r.suppressed) for r in K.link_tracks(spark.createDataFrame(rows, SCHEMA), K.CONFIDENT).collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (3, True)}


def test_components_of_a_graph(spark):
    edges = [(5, 3), (3, 9), (1, 2), (2, 1), (7, 7), (20, 21), (21, 22), (22, 23), (23, 20), *((100, 101 + i) for i in range(50)), *((200 + i, 201 + i) for i in range(40))]
    got = {r.node: r.root for r in K.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {3: 3, 5: 3, 9: 3, 1: 1, 2: 1, **{i: 20 for i in range(20, 24)}, **{i: 100 for i in range(100, 151)}, **{i: 200 for i in range(200, 241)}}
    assert got == want
    assert K.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_pairs_are_never_broadcast(spark):
    """A few packed rows look small to the planner, the tiled rows made from them are not."""
    df, _ = random_boxes(spark, 50)
    assert "Broadcast" not in D.near_pairs(df, df, ["category"], "event_id", 5, 0.2)._jdf.queryExecution().executedPlan().toString()


def test_cascade_modes_in_one_pass(spark):
    """All modes give what each gives alone, and the query's rows meet once."""
    from pyspark.sql import functions as F
    import __spark_entry__ as entry
    df = spark.createDataFrame([(i, i / 10, (7 * i % 11) / 10, float(i % 3)) for i in range(12)] + [(12, None, 0.5, 1.0), (13, 0.5, None, 1.0)], "event_id long, a double, b double, c double")
    args = F.col("a"), F.col("b"), F.col("c"), (0.3, 0.4)
    got = D.cascades(df, D.CASCADE_MODES, *args).select("mode", "event_id", "status", "diff_score", "small_score", "detector_score").collect()
    want = [(m, *r) for m in D.CASCADE_MODES for r in D.cascade(df, m, *args).select("event_id", "status", "diff_score", "small_score", "detector_score").collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    plan = entry.queries()["P11_cascade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "BroadcastHashJoin" not in plan


def test_assignments_with_many_ways_are_settled_in_order():
    """Ties that small disturbances did not show."""
    ties = [np.array([[0, 0, 4, 2, 0], [0, 0, 0, 0, 0], [0, 0, 0, 2, 0], [4, 4, 4, 0, 0]]) / 4,
            np.array([[0, 0, 0, 0, 1], [4, 1, 0, 2, 1], [2, 4, 0, 3, 2], [1, 0, 0, 0, 1], [2, 4, 0, 1, 0], [0, 4, 0, 4, 3]]) * 0.075]
    rng = np.random.default_rng(3)
    ties += [rng.integers(0, 4, rng.integers(1, 8, 2)) * 0.25 for _ in range(200)]
    for gain in ties:
        assert K.settled_assignment(gain) == K._tried_in_order(gain, 1e-9)
    assert K.settled_assignment(np.ones((150, 400))) == [(i, i) for i in range(150)]


@pytest.mark.parametrize("rules", [K.SIMPLE, K.CONFIDENT])
def test_links_of_a_crowd_connect_like_all_pairs_and_grow_with_the_boxes(spark, rules):
    """Crowded frames: few links, the components of all pairs."""
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 400, 900).tolist(), rng.integers(0, 120, 900).tolist()
    rows = [(i, "a", int(rng.integers(12)), float(x[i]), float(y[i]), float(x[i] + 60), float(y[i] + 60), 1.0) for i in range(900)]
    links = [tuple(r) for r in K.linkable(spark.createDataFrame(rows, SCHEMA), rules, ["category"], "event_id").collect()]
    assert len(links) < 6 * len(rows)
    box, frame = np.array([r[3:7] for r in rows]), np.array([r[2] for r in rows])
    gap, overlap = np.abs(frame[:, None] - frame), np_iou(box, box)
    near = (gap > 0) & (gap <= rules.back) & (overlap >= rules.iou_min)
    if rules.suppress_above is not None:
        near |= (gap == 0) & (overlap > rules.suppress_above)

    def components(pairs):
        name = list(range(len(rows)))
        for _ in range(len(rows)):
            before = list(name)
            for a, b in pairs:
                name[a] = name[b] = min(name[a], name[b])
            if name == before:
                return name

    assert components(links) == components(list(zip(*(v.tolist() for v in np.nonzero(near)))))


def test_overlaps_by_strips_equal_the_matrix():
    rng = np.random.default_rng(2)
    for size in (1, 40, 4000):
        corner = rng.random((400, 2)) * size
        a, b = (np.concatenate([c, c + rng.random(c.shape) * 60 - 1], axis=1) for c in (corner, corner[::-1] + 7))
        a[3, 0], b[5, 3] = np.nan, np.inf
        iou = np_iou(a, b)
        i, j, got = boxes.overlaps(a, b, 0.1)
        p, q = np.nonzero(iou >= 0.1)
        assert i.tolist() == p.tolist() and j.tolist() == q.tolist() and (got == iou[p, q]).all()


def test_a_crowded_frame_compares_pairs_in_sight_only():
    """2000 boxes against 6000 tracks, a tenth of the matrix by the look-up, and nothing as large as the matrix in the assignment."""
    rng = np.random.default_rng(6)
    box, live = (np.concatenate([c, c + 50], axis=1) for c in (rng.integers(0, 3000, (n, 2)).astype(float) for n in (2000, 6000)))
    seen = []
    whole, K.np_iou, boxes.np_iou = boxes.np_iou, *[lambda a, b: seen.append(len(a) * len(b)) or whole(a, b)] * 2
    try:
        tracks = K.LiveTracks(np.arange(6000), live, np.zeros(6000, np.int64))
        tids, _ = K.link_frame(tracks, K.CONFIDENT, 1, np.arange(10_000, 12_000), box, np.ones(2000))
    finally:
        K.np_iou = boxes.np_iou = whole
    assert max(seen, default=0) <= boxes.DENSE
    iou = np_iou(box, live)
    mine = [(r, int(t)) for r, t in enumerate(tids) if t < 6000]
    row, col = np.nonzero(iou >= 0.01)
    match, u, v = K._best(2000, 6000, row, col, iou[row, col])
    assert (u >= -1e-12).all() and (v >= -1e-12).all() and (u[row] + v[col] - iou[row, col] >= -1e-9).all()
    assert u.sum() + v.sum() == pytest.approx(sum(iou[r, c] for r, c in mine)) and len({c for _, c in mine}) == len(mine)


def test_best_partners_of_a_crowd_equal_all_pairs_and_grow_with_the_boxes(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(12)
    x, y = rng.integers(0, 300, 900).tolist(), rng.integers(0, 90, 900).tolist()
    rows = [(i if i else None, "a", int(rng.integers(40)), float(x[i]), float(y[i]), float(x[i] + 60), float(y[i] + 60), 1.0) for i in range(900)]
    df = spark.createDataFrame(rows + rows[5:9], SCHEMA)
    offers = K.best_partners(df, ["category"], "event_id", 30, 0.5)
    assert offers.count() < 8 * len(rows)
    pairs = D.near_pairs(df, df, ["category"], "event_id", 30, 0.5)
    assert pairs.count() > 3 * offers.count()
    near, far = F.struct("iou", "old_frame", (-F.col("old_id")).alias("o")), F.struct("iou", (-F.col("new_frame")).alias("f"), (-F.col("new_id")).alias("n"))
    old = {tuple(r) for r in pairs.groupBy("new_id").agg(F.max_by("old_id", near)).dropna(subset=["new_id"]).collect()}
    new = {tuple(r) for r in pairs.groupBy("old_id").agg(F.max_by("new_id", far)).dropna(subset=["old_id"]).collect()}
    best = lambda side, rank: {tuple(r) for r in offers.where(side).groupBy("id").agg(F.max_by("other", F.struct("iou", rank.alias("f"), (-F.col("other")).alias("o")))).collect()}
    assert best("earlier", F.col("frame")) == old and best("NOT earlier", -F.col("frame")) == new

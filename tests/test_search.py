import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.functions.scoring import RandomScorer, gamma_draw, gamma_quantile, log_gamma
from framesift.plans import bounds
from framesift.plans import search as S
from framesift.operators import estimators, stats


def small(spark, frames=60, chunk=20):
    f = spark.range(frames).select(F.col("id").alias("frame_id"), F.floor(F.col("id") / chunk).alias("chunk_id"))
    rng = np.random.default_rng(0)
    hits = spark.createDataFrame([("a", int(rng.integers(frames)), int(rng.integers(12))) for _ in range(60)], "category string, frame_id long, track_id long").distinct()
    return f, hits


def test_picks_fall_to_the_next_chunk_when_one_is_exhausted(spark):
    """Draws in order take their best chunk with frames left, as a plain loop does."""
    rng = np.random.default_rng(0)
    rows, want = [], []
    for e in range(40):
        draws, chunks = int(rng.integers(1, 12)), int(rng.integers(1, 5))
        left, score = rng.integers(1, 5, chunks), rng.random((draws, chunks))
        rows += [(f"e{e}", 0, 0, d, c, int(left[c]), float(score[d, c])) for d in range(draws) for c in range(chunks)]
        now, at, turns = left.copy(), 0, [0] * chunks
        for d in range(draws):
            open_ = np.flatnonzero(now > 0)
            if not len(open_):
                break
            c = int(open_[score[d, open_].argmax()])
            want.append((f"e{e}", at, c, turns[c]))
            now[c], at, turns[c] = now[c] - 1, at + 1, turns[c] + 1
    got = S.taken(spark.createDataFrame(rows, "experiment string, seed long, step int, draw int, chunk_id long, left long, score double"))
    assert sorted(map(tuple, got.select("experiment", "at", "chunk_id", "turn").collect())) == sorted(want)


def slow_cdf(a, x):
    """Regularised lower incomplete gamma by adding up small steps of the density, exactly known at its end."""
    from math import exp, lgamma, log
    total, term, k = 0.0, 1.0, 0
    while term > 1e-18 * max(total, 1e-300) and k < 5000:
        total += term
        k += 1
        term *= x / (a + k)
    return exp(a * log(x) - x - lgamma(a + 1)) * total


def test_gamma_quantile_inverts_the_cdf(spark):
    shapes, qs = [0.1, 0.5, 1.0, 3.1, 40.0, 900.1], [0.05, 0.5, 0.9, 0.999, 1 - 1e-6]
    df = spark.createDataFrame([(a, q) for a in shapes for q in qs], "a double, q double")
    for r in df.select("a", "q", gamma_quantile(F.col("a"), F.col("q")).alias("x"), log_gamma(F.col("a")).alias("g")).collect():
        assert slow_cdf(r.a, r.x) == pytest.approx(r.q, abs=1e-9)
        assert r.g == pytest.approx(math.lgamma(r.a), abs=1e-11)
    one = spark.range(1).select(gamma_quantile(F.lit(1.0), F.lit(0.5)).alias("x")).first().x
    assert one == pytest.approx(np.log(2))


def test_draws_follow_their_distributions(spark):
    """Mean, variance and share below the median of gamma draws; moments of normal ones; the same again on other partitions."""
    rows = spark.range(20000).select(F.lit(7).alias("seed"), F.lit(1).alias("step"), F.col("id").alias("draw"), F.lit(3).alias("chunk_id"))
    for a in (0.1, 1.1, 5.1, 300.0):
        got = np.array([r.x for r in rows.select(gamma_draw(F.lit(a)).alias("x")).collect()])
        again = {r.draw: r.x for r in rows.repartition(3).select("draw", gamma_draw(F.lit(a)).alias("x")).collect()}
        assert got.tolist() == [again[i] for i in range(len(got))]
        assert (got > 0).all() and got.mean() == pytest.approx(a, rel=0.1) and got.var() == pytest.approx(a, rel=0.2)
        median = spark.range(1).select(gamma_quantile(F.lit(a), F.lit(0.5)).alias("x")).first().x
        assert (got < median).mean() == pytest.approx(0.5, abs=0.02)
    z = np.array([r.x for r in rows.select(RandomScorer().per_draw().alias("x")).collect()])
    assert abs(z.mean()) < 0.03 and z.std() == pytest.approx(1, abs=0.03) and (z ** 3).mean() == pytest.approx(0, abs=0.1)


def test_search_visits_every_frame_once_and_in_queue_order(spark):
    frames, hits = small(spark)
    # A track outside the queues keeps the search from stopping when all others are found.
    real, hits = hits, hits.union(spark.createDataFrame([("a", 999, 999)], hits.schema))
    queues = S.make_queues(frames, frames, {"o": 1})
    search = S.start(queues, hits, [S.Experiment("e", "a", "o", "gt_ts"), S.Experiment("r", "a", "o", "random")], 25, S.Stop(frames=1000))
    log = S.run(search).cache()
    order = {(r.chunk_id, r.frame_id): r.pos for r in queues.collect()}
    for e in ("e", "r"):
        rows = log.where((F.col("experiment") == e) & F.col("track_id").isNull()).orderBy("sample_id").collect()
        assert [r.sample_id for r in rows] == list(range(60))
        assert len({r.frame_id for r in rows}) == 60
        for c in range(3):
            assert [order[(c, r.frame_id)] for r in rows if r.chunk_id == c] == list(range(20))
    found = log.where("track_id IS NOT NULL").select("experiment", "frame_id", "track_id").distinct().count()
    assert found == 2 * real.count()
    curve = S.history(log, search.config(), 25)
    assert {r.ni for r in curve.groupBy("experiment").agg(F.max("ni").alias("ni")).collect()} == {real.select("track_id").distinct().count()}


def test_search_repeats_itself(spark):
    frames, hits = small(spark)
    logs = []
    for _ in range(2):
        search = S.start(S.make_queues(frames, frames, {"o": 1}), hits, [S.Experiment("e", "a", "o", "gt_ts", seed=7)], 10, S.Stop(frames=20))
        logs.append([tuple(r) for r in S.run(search).orderBy("sample_id", "track_id").collect()])
    assert logs[0] == logs[1]


def test_a_search_goes_on_where_it_was_left(spark):
    frames, hits = small(spark)
    queues = S.make_queues(frames, frames, {"o": 1})
    experiments = [S.Experiment("e", "a", "o", "gt_ts", seed=7), S.Experiment("r", "a", "o", "random", seed=7)]
    whole = S.run(S.start(queues, hits, experiments, 10, S.Stop(results=0.9)))
    left = S.start(queues, hits, experiments, 10, S.Stop(results=0.9))
    S.run(left, max_steps=2)
    # A step that died half way left a part of its folders behind.
    left.log().limit(3).write.parquet(f"{left.path}/log/step=2")
    again = S.reopen(spark, left.path, experiments, 10, S.Stop(results=0.9))
    assert again.steps == 2
    rows = lambda log: sorted(map(tuple, log.collect()), key=repr)
    assert rows(S.run(again)) == rows(whole)
    for r in S.invariants(again, queues).collect():
        assert (r.frames_twice, r.queue_gaps, r.ids_skipped, r.reached, r.overrun) == (0, 0, 0, True, False)


def test_kept_counters_equal_a_recount(spark):
    frames, hits = small(spark)
    search = S.start(S.make_queues(frames, frames, {"o": 1}), hits, [S.Experiment("e", "a", "o", "gt_ts")], 7, S.Stop(results=0.8))
    log = S.run(search)
    kept = {r.chunk_id: r for r in S.counters(search.seen(), search.looked()).collect()}
    for r in stats.chunk_counters(log, ["experiment"]).collect():
        k = kept[r.chunk_id]
        assert (k.n_frames, k.n_hit_frames, k.n_hits, k.n_once or 0, k.n_unique or 0) == (r.n_frames, r.n_hit_frames, r.n_hits, r.n_once, r.n_unique)


def test_stop_rules(spark):
    frames, hits = small(spark)
    queues = S.make_queues(frames, frames, {"o": 1})
    total = hits.select("track_id").distinct().count()
    search = S.start(queues, hits, [S.Experiment("e", "a", "o")], 10, S.Stop(results=0.5))
    log = S.run(search)
    ni = log.select("track_id").distinct().where("track_id IS NOT NULL").count()
    assert ni >= -(-total // 2)
    before = log.where(F.col("sample_id") < (search.steps - 1) * 10)
    assert before.select("track_id").distinct().where("track_id IS NOT NULL").count() < -(-total // 2)
    capped = S.start(queues, hits, [S.Experiment("e", "a", "o")], 10, S.Stop(frames=30))
    assert S.run(capped).where("track_id IS NULL").count() == 30


def test_greedy_search_equals_sequential(spark):
    """With the mean policy only ties are random; chunks of different size make them rare enough to replay."""
    frames, hits = small(spark)
    queues = S.make_queues(frames, frames, {"o": 1})
    search = S.start(queues, hits, [S.Experiment("e", "a", "o", "unique_none", seed=3)], 1, S.Stop(frames=8))
    rows = S.run(search).where("track_id IS NULL").orderBy("sample_id").collect()
    of = {}
    for r in hits.collect():
        of.setdefault(r.frame_id, set()).add(r.track_id)
    seen, n = {c: set() for c in range(3)}, {c: 0 for c in range(3)}
    for r in rows:
        mean = {c: (len(seen[c]) + 0.1) / (n[c] + 1) for c in range(3)}
        assert mean[r.chunk_id] == pytest.approx(max(mean.values()))
        seen[r.chunk_id] |= of.get(r.frame_id, set())
        n[r.chunk_id] += 1


def test_counts_equal_updates(spark):
    rng = np.random.default_rng(5)
    rows = [("e", i, int(rng.integers(3)), i, int(rng.integers(6)) if rng.random() < 0.7 else None) for i in range(120)]
    log = spark.createDataFrame(rows, "experiment string, sample_id long, chunk_id long, frame_id long, track_id long")
    got = {r.chunk_id: r for r in stats.chunk_counters(log).collect()}
    for c in range(3):
        mine = [r for r in rows if r[2] == c]
        seen = [r[4] for r in mine if r[4] is not None]
        assert (got[c].n_frames, got[c].n_hits) == (len(mine), len(seen))
        assert got[c].n_unique == len(set(seen)) and got[c].n_once == sum(seen.count(t) == 1 for t in set(seen))


def test_optimal_allocation_beats_a_grid(spark):
    rng = np.random.default_rng(6)
    p = np.where(rng.random((30, 2)) < 0.5, rng.random((30, 2)) * 0.02, 0.0)
    rows = [("a", t, c, float(p[t, c])) for t in range(30) for c in range(2) if p[t, c] > 0]
    df = spark.createDataFrame(rows, "category string, track_id long, chunk_id long, p double")
    live = p[p.sum(axis=1) > 0]
    best = min(np.exp(-live @ np.array([w, 200 - w])).sum() for w in np.linspace(0, 200, 2001))
    out = bounds.optimal_allocation(df, spark.createDataFrame([("a", 200.0)], "category string, n double"), tolerance=1e-4).collect()
    assert sum(r.w for r in out) == pytest.approx(200)
    assert out[0].misses == pytest.approx(best, rel=2e-3)


def test_uniform_match_hits_its_target(spark):
    df = spark.createDataFrame([("a", t, 0, 0.001 * (t + 1)) for t in range(20)], "category string, track_id long, chunk_id long, p double")
    target = spark.createDataFrame([("a", "half", 10.0), ("a", "few", 2.0)], "category string, target_id string, misses double")
    for r in bounds.uniform_match(df, target, 4).collect():
        x = 0.001 * np.arange(1, 21) / 4
        assert np.exp(-r.n_uniform * x).sum() == pytest.approx(r.misses, rel=1e-5)


def test_probabilities_that_sum_to_one_are_refused(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.5)], "category string, p double")
    with pytest.raises(Exception, match="sum to 1"):
        estimators.expected_finds(df, [1.0]).collect()


def test_adaptive_search_needs_fewer_frames_on_skewed_data(spark):
    """Direction only, over several seeds: objects sit in a few chunks, half of them are wanted."""
    from queries import q_search as Q
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sf, seeds = "/root/testdata/sf0.01", range(1, 8)
    queues = Q.queues(spark, sf, {f"o{i}": i for i in seeds})
    hits = Q.skew_hits(spark, sf).where("category = 'click'")
    experiments = [S.Experiment(f"{s}|{i}", "click", f"o{i}", s, seed=i) for s in ("gt_ts", "random") for i in seeds]
    search = S.start(queues, hits, experiments, 100, S.Stop(results=0.5))
    log = S.run(search, max_steps=20)
    used = log.groupBy("experiment").agg(F.count_distinct("sample_id").alias("nf")).collect()
    nf = {s: np.median([r.nf for r in used if r.experiment.startswith(s)]) for s in ("gt_ts", "random")}
    assert nf["gt_ts"] < nf["random"]


def test_allocation_steps_equal_sums_and_pass_on_no_tracks(spark):
    """A step's sums are those of a plain loop, and only sums per chunk are shuffled, once for all targets."""
    rng = np.random.default_rng(8)
    rows = [("ab"[t % 2], t, int(c), float(rng.random() / 50)) for t in range(40) for c in rng.choice(5, int(rng.integers(1, 5)), replace=False)]
    p = spark.createDataFrame(rows, "category string, track_id long, chunk_id int, p double")
    tracks, chunks = bounds._by_track(p)
    w = chunks.join(spark.createDataFrame([("a", 10.0), ("a", 70.0), ("b", 30.0)], "category string, n double"), "category").withColumn("w", F.col("n") / (F.col("chunk_id") + 2))
    out = bounds._pull(tracks, w, "n")
    got = {(r.category, r.n, r.chunk_id): r for r in out.collect()}
    assert len(got) == len({(k, c) for k, _, c, _ in rows if k == "a"}) * 2 + len({c for k, _, c, _ in rows if k == "b"})
    for (k, n, c), r in got.items():
        left = {t: math.exp(-sum(x * n / (d + 2) for k2, t2, d, x in rows if t2 == t)) for k2, t, _, _ in rows if k2 == k}
        total = {t: sum(x for _, t2, _, x in rows if t2 == t) for t in left}
        mine = [(t, x) for k2, t, d, x in rows if k2 == k and d == c]
        want = [sum(x * left[t] for t, x in mine), sum(x * left[t] * total[t] for t, x in mine), max(x for _, x in mine), sum(left.values()), len(left)]
        assert [r.g, r.fall, r.top, r.misses, r.objects] == pytest.approx(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("track_id" in line for line in plan.splitlines() if "Exchange" in line)

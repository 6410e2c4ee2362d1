from pyspark.sql import functions as F

from framesift.functions import scoring as SC
from framesift.functions.hooks import detector_stage
from framesift.operators import prep
from framesift.plans import search as S
from queries import views
from queries.q_detections import recursive
from queries.q_orders import open_frames
from queries.registry import query
from queries.views import CATEGORIES, det_skew, excluded, frames, hits, with_views


def skew_hits(spark, d):
    return prep.usable_boxes(det_skew(spark, d), excluded(spark, d), CATEGORIES).select("category", "frame_id", "track_id").distinct()


views.define("skew_hits", """SELECT DISTINCT category, frame_id, track_id FROM det_skew WHERE split = 'test' AND track_id IN (
  SELECT track_id FROM det_skew GROUP BY category, track_id HAVING count(*) >= 3)""", "det_skew")


def queues(spark, d, seeds):
    return S.make_queues(open_frames(spark, d), frames(spark, d), seeds)


@query("Q8_chunk_queues_by_seed", with_views("open_frames", "frames", body="""
SELECT 's' || seed AS order_id, chunk_id, frame_id, row_number() OVER (PARTITION BY seed, chunk_id ORDER BY md5(seed || ':' || frame_id)) - 1 AS pos
FROM open_frames JOIN frames USING (frame_id), (SELECT unnest([21, 22, 23]) AS seed)"""))
def q8(spark, d):
    return queues(spark, d, {f"s{i}": i for i in (21, 22, 23)})


def key_sql(salt):
    return f"md5(concat_ws(':', seed, step, draw, chunk_id, {salt}))"


def unit_sql(key, part=0):
    return f"((('0x' || substr({key}, {10 * part + 1}, 10))::BIGINT)::DOUBLE + 0.5) / {1 << 40}e0"


def normal_sql(key):
    return f"sqrt(-2e0 * ln({unit_sql(key, 0)})) * cos(2e0 * pi() * ({unit_sql(key, 1)}))"


def gamma_draw_sql(shape):
    """First shifted normal cube that passes the rejection test for shape + 1, brought down by a power of a uniform number."""
    d = f"({shape} + 2e0 / 3e0)"
    cubes = f"""list_transform(list_transform(list_transform(range(1, {SC.TRIES + 1}), lambda k: {key_sql('k')}),
      lambda h: {{'x': {normal_sql('h')}, 'w': {unit_sql('h', 2)}}}), lambda s: {{'x': s.x, 'w': s.w, 'v': pow(1e0 + s.x / sqrt(9e0 * {d}), 3)}})"""
    passed = f"list_filter({cubes}, lambda s: s.v > 0 AND ln(s.w) < 0.5 * s.x * s.x + {d} - {d} * s.v + {d} * ln(CASE WHEN s.v > 0 THEN s.v ELSE 1e0 END))"
    return f"({d} * coalesce({passed}[1].v, 1e0) * pow({unit_sql(key_sql(0))}, 1e0 / ({shape})))"


def gamma_quantile_sql(shape, q):
    """By halving; the distribution function is a power series."""
    series = f"""list_reduce(range(1, (60 + 14 * sqrt({shape} + 30))::BIGINT + 2), lambda t, k: {{'term': t.term * m.x / ({shape} + k), 'total': t.total + t.term * m.x / ({shape} + k)}}, {{'term': 1e0, 'total': 1e0}}).total"""
    below = f"exp(({shape}) * ln(m.x) - m.x - lgamma({shape} + 1)) * {series}"
    halved = f"""list_transform([{{'lo': b.lo, 'hi': b.hi, 'x': (b.lo + b.hi) / 2}}], lambda m: CASE WHEN {below} < {q} THEN {{'lo': m.x, 'hi': m.hi}} ELSE {{'lo': m.lo, 'hi': m.x}} END)[1]"""
    return f"list_transform([list_reduce(range({SC.HALVINGS}), lambda b, i: {halved}, {{'lo': 0e0, 'hi': {shape} + 10 * sqrt({shape}) + 60}})], lambda b: (b.lo + b.hi) / 2)[1]"


def score_sql(name, per_draw):
    """Score of a row with seed, step, chunk_id, sampled, the chunk's counters and, where it is one per draw, the draw."""
    scorer = S.SCORERS[name]
    if per_draw != scorer.draws:
        return None
    if isinstance(scorer, SC.RandomScorer):
        return normal_sql(key_sql(0))
    shape, rate = ("1e0", "1e0") if scorer.stat == "uniform" else (f"({SC.STATISTICS[scorer.stat]} + {scorer.alpha}::DOUBLE)", f"(n + {scorer.beta}::DOUBLE)")
    if scorer.policy == "ts":
        return f"{gamma_draw_sql(shape)} / {rate}"
    return f"{shape} / {rate}" if scorer.policy == "none" else f"{gamma_quantile_sql(shape, '(1e0 - 1e0 / (sampled + 1e0))')} / {rate}"


def search_sql(names, seeds, batch, results=0.9, steps=None, hits="hits"):
    """Views that end in ``walk`` and ``log``: a whole search, one step of all experiments per round of the recursion.

    What a chunk's queue has shown after its first n frames depends on n alone, so its counters are looked up.
    """
    own, shared = ("CASE scorer " + " ".join(f"WHEN '{n}' THEN {x}" for n in names if (x := score_sql(n, per_draw))) + " WHEN '' THEN 0e0 END" for per_draw in (True, False))
    more = f"step = 0 OR ni < ceil(total * {results})" if steps is None else f"(step = 0 OR ni < ceil(total * {results})) AND step < {steps}"
    return f"""
queue AS (SELECT seed, chunk_id, frame_id, row_number() OVER (PARTITION BY seed, chunk_id ORDER BY md5(seed || ':' || frame_id), frame_id) - 1 AS pos
  FROM open_frames JOIN frames USING (frame_id), (SELECT unnest({list(seeds)}) AS seed)),
lens AS (SELECT seed, chunk_id, count(*) AS len, dense_rank() OVER (ORDER BY chunk_id) AS idx FROM queue GROUP BY 1, 2),
sight AS (SELECT *, row_number() OVER (PARTITION BY seed, category, chunk_id, track_id ORDER BY pos) AS k FROM {hits} JOIN queue USING (frame_id)),
news AS (SELECT seed, category, chunk_id, pos, count(*) AS hit, count(*) FILTER (k = 1) AS fresh, count(*) FILTER (k = 1) - count(*) FILTER (k = 2) AS single FROM sight GROUP BY ALL),
kinds AS (SELECT category, count(DISTINCT track_id) AS total FROM {hits} GROUP BY 1),
counts AS (
  SELECT seed, category, chunk_id, 0 AS n, 0 AS n_hits, 0 AS n_once, 0 AS n_unique FROM lens, kinds UNION ALL
  SELECT seed, category, chunk_id, pos + 1, coalesce(sum(hit) OVER w, 0), coalesce(sum(single) OVER w, 0), coalesce(sum(fresh) OVER w, 0)
  FROM (SELECT * FROM queue, kinds) LEFT JOIN news USING (seed, category, chunk_id, pos) WINDOW w AS (PARTITION BY seed, category, chunk_id ORDER BY pos)),
finds AS (SELECT s.seed, category, track_id, idx, pos FROM sight s JOIN lens l ON l.seed = s.seed AND l.chunk_id = s.chunk_id WHERE k = 1),
walk AS (
  SELECT category, scorer, seed, 0 AS step, list_transform(range((SELECT max(idx) FROM lens)), lambda i: 0::BIGINT) AS before,
    list_transform(range((SELECT max(idx) FROM lens)), lambda i: 0::BIGINT) AS used, []::BIGINT[] AS picks, 0::BIGINT AS sampled, 0::BIGINT AS ni
  FROM kinds, (SELECT unnest({list(names)}) AS scorer), (SELECT unnest({list(seeds)}) AS seed)
  UNION ALL
  SELECT category, scorer, seed, step + 1, before, used, picks, sampled + len(picks), count(DISTINCT track_id) FROM (
    SELECT t.*, f.track_id FROM (
      SELECT category, scorer, seed, step, used AS before, list_transform(range(1, len(used) + 1), lambda i: used[i] + got.n[i]) AS used, got.p AS picks, sampled FROM (
        SELECT category, scorer, seed, step, used, sampled, list_reduce(list(o ORDER BY draw), lambda acc, o: list_transform([list_filter(o, lambda x: acc.n[x.c] < x.l)], lambda free:
            CASE WHEN len(free) = 0 THEN acc ELSE {{'n': list_transform(range(1, len(acc.n) + 1), lambda i: acc.n[i] + CASE WHEN i = free[1].c THEN 1 ELSE 0 END), 'p': list_append(acc.p, free[1].c)}} END)[1],
            {{'n': list_transform(used, lambda u: 0::BIGINT), 'p': []::BIGINT[]}}) AS got
        FROM (SELECT category, scorer, seed, step, used, sampled, draw, list({{'c': idx, 'l': l}} ORDER BY score DESC, tie, chunk_id) AS o
          FROM (SELECT *, coalesce(shared, {own}) AS score, {key_sql("'tie'")} AS tie
            FROM (SELECT *, {shared} AS shared
              FROM (SELECT w.category, w.scorer, w.seed, w.step, w.used, w.sampled, l.idx, l.chunk_id, l.len - w.used[l.idx] AS l, c.n, c.n_hits, c.n_once, c.n_unique
                FROM walk w JOIN kinds k ON k.category = w.category JOIN lens l ON l.seed = w.seed
                JOIN counts c ON c.seed = w.seed AND c.category = w.category AND c.chunk_id = l.chunk_id AND c.n = w.used[l.idx]
                WHERE ({more}) AND l.len > w.used[l.idx])), (SELECT unnest(range({batch})) AS draw) d)
          GROUP BY category, scorer, seed, step, used, sampled, draw)
        GROUP BY category, scorer, seed, step, used, sampled)) t
      LEFT JOIN finds f ON f.seed = t.seed AND f.category = t.category AND f.pos < t.used[f.idx])
  GROUP BY category, scorer, seed, step, before, used, picks, sampled),
picked AS (SELECT category, scorer, seed, step, before, sampled - len(picks) + i AS sample_id, picks[i + 1] AS idx, list_count(list_filter(picks[:i], lambda c: c = picks[i + 1])) AS turn
  FROM (SELECT *, unnest(range(len(picks))) AS i FROM walk WHERE step > 0)),
log AS (SELECT p.category || '|' || scorer || '|' || p.seed AS experiment, p.category, sample_id, l.chunk_id, q.frame_id
  FROM picked p JOIN lens l ON l.seed = p.seed AND l.idx = p.idx JOIN queue q ON q.seed = p.seed AND q.chunk_id = l.chunk_id AND q.pos = before[p.idx] + turn)"""


def whole_sql(names, seeds=(1, 2), body="", then="", **kw):
    """A whole search, views over it and what is wanted of them."""
    return recursive(with_views("open_frames", "frames", "hits", extra=search_sql(names, seeds, BATCH, **kw) + then, body=body))


#: Frames that an experiment looks at per step.
BATCH = 200
LOG_SQL = """SELECT experiment, sample_id, chunk_id::BIGINT AS chunk_id, frame_id, NULL::BIGINT AS track_id FROM log
UNION ALL SELECT experiment, sample_id, chunk_id::BIGINT, frame_id, track_id::BIGINT FROM log JOIN hits USING (frame_id, category)"""


def sweep(spark, d, names, seeds=(1, 2), batch=BATCH, stop=S.Stop(results=0.9), **kw):
    """Every category × scorer × repetition as one search, up to 0.9 of the objects."""
    experiments = [S.Experiment(f"{c}|{s}|{i}", c, f"o{i}", s, seed=i) for c in CATEGORIES for s in names for i in seeds]
    return S.start(queues(spark, d, {f"o{i}": i for i in seeds}), hits(spark, d), experiments, batch, stop, **kw)


@query("Q1_Q2_adaptive_search", whole_sql(["gt_ts", "random"], body=LOG_SQL))
def q1(spark, d):
    """Sampling log of a sweep over categories, scorers and repetitions."""
    return S.run(sweep(spark, d, ["gt_ts", "random"]))


@query("Q2_kept_counters", whole_sql(["gt_none", "unique_ts"], seeds=(1,), then=f""",
seen AS ({LOG_SQL}),
often AS (SELECT experiment, chunk_id, track_id, count(*) AS n FROM seen WHERE track_id IS NOT NULL GROUP BY ALL)""", body="""
SELECT experiment, chunk_id, count(DISTINCT frame_id) AS n_frames, count(track_id) AS n_hits, count(DISTINCT frame_id) FILTER (track_id IS NOT NULL) AS n_hit_frames,
  coalesce(any_value(n_once), 0) AS n_once, count(DISTINCT track_id) AS n_unique
FROM seen LEFT JOIN (SELECT experiment, chunk_id, count(*) AS n_once FROM often WHERE n = 1 GROUP BY ALL) USING (experiment, chunk_id) GROUP BY experiment, chunk_id"""))
def q2(spark, d):
    """The counters that a search keeps from step to step, after its last; the SQL counts them from the log."""
    s = sweep(spark, d, ["gt_none", "unique_ts"], seeds=(1,))
    S.run(s)
    return S.counters(s.seen(), s.looked()).select("experiment", "chunk_id", "n_frames", "n_hits", "n_hit_frames",
                                                   *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_once", "n_unique")])


@query("Q1_search_invariants", with_views("det", body="""
SELECT category || '|' || scorer || '|' || seed AS experiment, 0::bigint AS frames_twice, 0::bigint AS queue_gaps, 0::bigint AS ids_skipped,
  true AS reached, false AS overrun
FROM (SELECT DISTINCT category FROM det), (SELECT unnest(['gt_ts', 'unique_bayes_ucb']) AS scorer), (SELECT unnest([1, 2]) AS seed)"""))
def q1_invariants(spark, d):
    """A search that stops half way is taken up again; then what every search must keep is recounted."""
    s = sweep(spark, d, ["gt_ts", "unique_bayes_ucb"])
    S.run(s, max_steps=2)
    s = S.reopen(spark, s.path, s.experiments, s.batch, s.stop)
    S.run(s)
    return S.invariants(s, queues(spark, d, {f"o{i}": i for i in (1, 2)}))


def history_sql(names, seeds):
    return whole_sql(names, seeds=seeds, then=""",
steps AS (SELECT * FROM (SELECT *, lag(ni) OVER (PARTITION BY category, scorer, seed ORDER BY step) AS was FROM walk) WHERE step > 0)""", body="""
SELECT category || '|' || scorer || '|' || seed AS experiment, category, scorer, seq, nf, ni FROM (
  SELECT category, scorer, seed, 0::BIGINT AS seq, 0::BIGINT AS nf, 0::BIGINT AS ni FROM walk WHERE step = 0
  UNION ALL SELECT category, scorer, seed, 2 * step - 1, sampled - len(picks), was FROM steps WHERE ni > was
  UNION ALL SELECT category, scorer, seed, 2 * step, sampled, ni FROM steps WHERE ni > was)""")


@query("Q5_Q10_search_history", history_sql(["gt_ts", "unique_ts", "hits_none", "uniform_ts"], (1,)))
def q5(spark, d):
    s = sweep(spark, d, ["gt_ts", "unique_ts", "hits_none", "uniform_ts"], seeds=(1,))
    return S.history(S.run(s), s.config(), s.batch)


@query("B6_B7_B8_B9_scorers", whole_sql(list(S.SCORERS), seeds=(1,), steps=2, body="SELECT experiment, chunk_id::BIGINT AS chunk_id, count(*) AS frames FROM log GROUP BY ALL"))
def b6(spark, d):
    """The picks of one step under every scorer, from the statistics after one batch, with those of the batch."""
    s = sweep(spark, d, list(S.SCORERS), seeds=(1,))
    return S.run(s, max_steps=2).where("track_id IS NULL").groupBy("experiment", "chunk_id").agg(F.count(F.lit(1)).alias("frames"))


def optimistic(chunks, draws, rng):
    """A plug-in scorer: distinct tracks per frame with one free track."""
    return ((chunks["n_unique"] + 1) / (chunks["n_frames"] + 1)).to_numpy()[None, :].repeat(draws, axis=0)


@query("F2_scorer_plug_in")
def f2(spark, d):
    s = sweep(spark, d, ["optimistic"], seeds=(1,), scorers={"optimistic": optimistic})
    return S.history(S.run(s), s.config(), s.batch)


@query("Q12_search_with_detector", whole_sql(["gt_ts"], seeds=(1,), body=LOG_SQL))
def q12(spark, d):
    """The search runs a detector on the picked frames instead of looking hits up."""
    found_by = hits(spark, d)

    def detect(picked):
        found = picked.join(found_by, ["category", "frame_id"])
        keep = detector_stage(found.select("experiment", "sample_id", "chunk_id", "frame_id", "track_id"), lambda: (lambda pdf: pdf),
                              "experiment string, sample_id long, chunk_id long, frame_id long, track_id long")
        blank = picked.select("experiment", "sample_id", "chunk_id", "frame_id").withColumn("track_id", F.lit(None).cast("long"))
        return blank.unionByName(keep)

    return S.run(sweep(spark, d, ["gt_ts"], seeds=(1,), detector=detect))

"""Adaptive search: many experiments advance together, one Spark job per step.

Prepared once: ``feed`` (order_id, chunk_id, pos, frame_id, category, track_id), the queue of
every chunk with what its frames hold, laid out by blocks of queue positions so that a step reads
only the blocks it needs.

A step reads the state that the step before left, lets every experiment pick chunks (column expressions
over chunks and draws; see ``choose``), looks the picked frames up, and writes three things: the step's part of the sampling log, the sightings per
(experiment, chunk, track) so far, and the frame counters per (experiment, chunk) so far.  The log
itself is never read again by a search.  Every folder is written over on a retry, and a step counts
once its last folder is complete, so ``reopen`` goes on after the last whole step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.functions.ordinal import block_of, running
from framesift.functions.scoring import GammaScorer, RandomScorer, ScoreFunction, key_of
from framesift.operators import orders
from framesift.session import scratch_path

BLOCK = 1024
LOG = "experiment string, sample_id long, chunk_id long, frame_id long, track_id long"
SEEN = "experiment string, chunk_id long, track_id long, n long"
LOOKED = "experiment string, chunk_id long, n_frames long, n_hits long, n_hit_frames long"

# Named choices of the config grid.
Scorer = GammaScorer | RandomScorer | ScoreFunction
SCORERS: dict[str, Scorer] = {
    **{f"{s}_{p}": GammaScorer(s, p) for s in ("gt", "unique", "hits", "uniform") for p in ("ts", "bayes_ucb", "none")},
    "random": RandomScorer(),
}


@dataclass(frozen=True)
class Experiment:
    """One search: find objects of a category through an order cut into chunk queues."""

    name: str
    category: str
    order_id: str
    scorer: str = "gt_ts"
    seed: int = 0


@dataclass(frozen=True)
class Stop:
    """Stop at a share (float) or number (int) of objects, or at a number of frames."""

    results: float | int | None = None
    frames: int | None = None

    def results_for(self, total: int) -> int:
        if self.results is None:
            return total
        if isinstance(self.results, float):
            return min(total, math.ceil(total * self.results))
        return min(total, self.results)


@dataclass
class Search:
    """A prepared search; the folder ``path`` holds its whole state."""

    spark: SparkSession
    path: str
    experiments: Sequence[Experiment]
    batch: int
    stop: Stop
    scorers: dict[str, Scorer] = field(default_factory=lambda: SCORERS)
    detector: Callable | None = None
    steps: int = 0

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def log(self) -> DataFrame:
        """The sampling log of the steps that are whole."""
        if self.steps == 0:
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(LOG + ", step int").parquet(f"{self.path}/log")
        return rows.where(F.col("step") < self.steps).drop("step")

    def seen(self) -> DataFrame:
        return self.read(f"state/step={self.steps - 1}/seen") if self.steps else self.spark.createDataFrame([], SEEN)

    def looked(self) -> DataFrame:
        return self.read(f"state/step={self.steps - 1}/looked") if self.steps else self.spark.createDataFrame([], LOOKED)

    def config(self, step: int = 0) -> DataFrame:
        rows = [(e.name, e.category, e.order_id, e.scorer, e.seed, step) for e in self.experiments]
        return self.spark.createDataFrame(rows, "experiment string, category string, order_id string, scorer string, seed long, step int")


def prepare_feed(queues: DataFrame, hits: DataFrame, path: str) -> None:
    """Write chunk queues (order_id, chunk_id, pos, frame_id) joined with their hits.

    Every frame has one row without a track besides its hit rows, so empty frames count too.
    """
    found = queues.join(hits.select("frame_id", "category", "track_id"), "frame_id")
    empty = queues.withColumns({"category": F.lit(None).cast("string"), "track_id": F.lit(None).cast(hits.schema["track_id"].dataType)})
    rows = empty.unionByName(found).withColumn("pos_block", F.floor(F.col("pos") / BLOCK))
    cols = ["order_id", F.col("chunk_id").cast("long").alias("chunk_id"), "pos", "frame_id", "category", F.col("track_id").cast("long").alias("track_id"), "pos_block"]
    # Ranges of (block, order, chunk) keep the files of a block few and a crowded chunk spread.
    layout = ["pos_block", "order_id", "chunk_id"]
    rows.select(*cols).repartitionByRange(*layout).sortWithinPartitions(*layout, "pos").write.mode("overwrite").partitionBy("pos_block").parquet(path)


def make_queues(frames: DataFrame, chunks: DataFrame, order_seeds: dict[str, int]) -> DataFrame:
    """Random chunk queues for several seeds: (order_id, chunk_id, pos, frame_id)."""
    ids = F.array(*[F.struct(F.lit(k).alias("order_id"), F.lit(str(v)).alias("__seed")) for k, v in order_seeds.items()])
    rows = frames.select("frame_id", F.inline(ids)).join(chunks.select("frame_id", "chunk_id"), "frame_id")
    keyed = rows.withColumn("__key", F.md5(F.concat_ws(":", "__seed", F.col("frame_id").cast("string"))))
    ranked = orders.running(keyed, [F.col("__key"), F.col("frame_id")], orders.hex_bucket(F.col("__key"), 2), by=["order_id", "chunk_id"])
    return ranked.select("order_id", "chunk_id", "pos", "frame_id")


def start(queues: DataFrame, hits: DataFrame, experiments: Sequence[Experiment], batch: int, stop: Stop,
          scorers: dict[str, Scorer] | None = None, detector: Callable | None = None, path: str | None = None) -> Search:
    """Prepare a search in the folder ``path`` (a new scratch folder by default)."""
    spark = queues.sparkSession
    path = path or scratch_path(spark, "search")
    prepare_feed(queues, hits, f"{path}/feed")
    totals = hits.select("category", "track_id").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("total_ni"))
    totals.write.mode("overwrite").parquet(f"{path}/totals")
    sizes = spark.read.parquet(f"{path}/feed").where("category IS NULL").groupBy("order_id", "chunk_id").agg(F.count(F.lit(1)).alias("queue_len"))
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")
    return Search(spark, path, tuple(experiments), batch, stop, {**SCORERS, **(scorers or {})}, detector)


def reopen(spark: SparkSession, path: str, experiments: Sequence[Experiment], batch: int, stop: Stop,
           scorers: dict[str, Scorer] | None = None, detector: Callable | None = None) -> Search:
    """A search that was started in ``path``, after its last whole step."""
    search = Search(spark, path, tuple(experiments), batch, stop, {**SCORERS, **(scorers or {})}, detector)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    while store.exists(hadoop(f"{path}/state/step={search.steps}/looked/_SUCCESS")):
        search.steps += 1
    return search


def counters(seen: DataFrame, looked: DataFrame) -> DataFrame:
    """Per (experiment, chunk): the frame counters with tracks seen once and distinct tracks."""
    tracks = seen.groupBy("experiment", "chunk_id").agg(F.count_if(F.col("n") == 1).alias("n_once"), F.count(F.lit(1)).alias("n_unique"))
    return looked.join(tracks, ["experiment", "chunk_id"], "left")


def scored(search: Search, chunks: DataFrame) -> DataFrame:
    """One row per open chunk and draw with its ``score``; ``chunks`` are the open chunks of unfinished experiments."""
    draws = F.explode(F.sequence(F.lit(0), F.lit(search.batch - 1))).alias("draw")
    used = sorted({e.scorer for e in search.experiments})
    built_in = {n: search.scorers[n] for n in used if not callable(search.scorers[n])}
    out = None
    if built_in:
        shared, own = F.lit(None).cast("double"), F.lit(None).cast("double")
        for name, scorer in built_in.items():
            if scorer.draws:
                own = F.when(F.col("scorer") == name, scorer.per_draw()).otherwise(own)
            else:
                shared = F.when(F.col("scorer") == name, scorer.per_chunk()).otherwise(shared)
        mine = chunks.where(F.col("scorer").isin(*built_in)).withColumn("shared", shared)
        out = mine.select("*", draws).withColumn("score", F.coalesce("shared", own)).drop("shared")
    plugged = {n: search.scorers[n] for n in used if n not in built_in}
    if plugged:
        batch, step = search.batch, search.steps

        def plug_in(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("chunk_id", ignore_index=True)
            rng = np.random.default_rng([int(pdf["seed"].iloc[0]), step])
            scores = np.asarray(plugged[pdf["scorer"].iloc[0]](pdf, batch, rng), dtype=float)
            rows = pdf.loc[np.tile(np.arange(len(pdf)), batch)].reset_index(drop=True)
            return rows.assign(draw=np.repeat(np.arange(batch), len(pdf)), score=scores.ravel())

        schema = ", ".join(f"{n} {k}" for n, k in chunks.dtypes) + ", draw int, score double"
        rows = chunks.where(F.col("scorer").isin(*plugged)).groupBy("experiment").applyInPandas(plug_in, schema)
        out = rows if out is None else out.unionByName(rows)
    return out


def taken(options: DataFrame) -> DataFrame:
    """(experiment, at, chunk_id, turn): draws, one after the other, take their best chunk with frames left.

    ``options`` is one row per (experiment, draw, chunk_id) with score and ``left``.  Before a draw no more frames
    can be gone than there were draws, so of its chunks in order only so many count as hold more than that.
    """
    best = F.struct((-F.col("score")).alias("low"), key_of("tie").alias("tie"), "chunk_id", "left")
    ranked = options.groupBy("experiment", "draw").agg(F.array_sort(F.collect_list(best)).alias("o"))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("n"))

    def reach(acc, o):
        return F.when(acc["held"] > F.col("draw"), acc).otherwise(
            F.struct((acc["held"] + o["left"]).alias("held"), (acc["n"] + 1).alias("n")))

    needed = ranked.withColumn("o", F.slice("o", F.lit(1), F.aggregate("o", start, reach, lambda acc: acc["n"])))
    short = F.transform("o", lambda o: F.struct(o["chunk_id"].alias("chunk_id"), o["left"].alias("left")))
    draws = needed.groupBy("experiment").agg(F.array_sort(F.collect_list(F.struct("draw", short.alias("o")))).alias("draws"))
    none = F.array().cast("array<bigint>")

    def take(acc, d):
        free = F.filter(d["o"], lambda o: F.size(F.filter(acc, lambda c: c == o["chunk_id"])) < o["left"])
        return F.when(F.size(free) > 0, F.array_append(acc, F.get(free, 0)["chunk_id"])).otherwise(acc)

    picked = draws.select("experiment", F.posexplode(F.aggregate("draws", none, take)).alias("at", "chunk_id"))
    before = Window.partitionBy("experiment", "chunk_id").orderBy("at")
    return picked.withColumn("turn", F.row_number().over(before) - 1)


def choose(search: Search, step: int) -> DataFrame:
    """Picks of one step: (experiment, sample_id, order_id, category, chunk_id, pos).

    Chunks are scored per draw by expressions; what a draw can take is cut to few chunks before the draws
    of an experiment, at most ``batch`` rows, are gone through in order.
    """
    found = search.seen().groupBy("experiment").agg(F.count_distinct("track_id").alias("ni"))
    sampled = search.looked().groupBy("experiment").agg(F.sum("n_frames").alias("sampled"))
    # The step is a column and no literal, so that all steps run the same compiled code.
    config = search.config(step)
    table = (config.join(search.read("sizes"), "order_id").join(counters(search.seen(), search.looked()), ["experiment", "chunk_id"], "left")
             .join(found, "experiment", "left").join(sampled, "experiment", "left").join(search.read("totals"), "category", "left")
             .fillna(0, ["n_frames", "n_hits", "n_hit_frames", "n_once", "n_unique", "ni", "total_ni", "sampled"]))
    stop = search.stop
    total = F.col("total_ni")
    want = total if stop.results is None else F.least(total, F.ceil(total * F.lit(stop.results)) if isinstance(stop.results, float) else F.lit(stop.results))
    done = F.lit(step > 0) & ((F.col("ni") >= want) | (F.col("sampled") >= stop.frames if stop.frames is not None else F.lit(False)))
    left = F.col("queue_len") - F.col("n_frames")
    chunks = table.withColumn("left", left).where(~done & (left > 0))
    picks = taken(scored(search, chunks))
    own = chunks.select("experiment", "chunk_id", "order_id", "category", "sampled", "n_frames")
    return picks.join(own, ["experiment", "chunk_id"]).select(
        "experiment", "order_id", "category", (F.col("sampled") + F.col("at")).alias("sample_id"), "chunk_id", (F.col("n_frames") + F.col("turn")).alias("pos"))


def advance(search: Search) -> bool:
    """One step of every unfinished experiment; False when none had anything left to do."""
    spark, step = search.spark, search.steps
    picks_path = f"{search.path}/picks/step={step}"
    choose(search, step).withColumn("pos_block", F.floor(F.col("pos") / BLOCK)).write.mode("overwrite").parquet(picks_path)
    picks = spark.read.parquet(picks_path)
    if picks.isEmpty():
        return False
    # The block is a partition of the feed, so the join prunes it by the blocks that the picks hold.
    wanted = picks.withColumnRenamed("category", "__category")
    rows = search.read("feed").join(wanted, ["pos_block", "order_id", "chunk_id", "pos"])
    if search.detector is None:
        rows = rows.where(F.col("category").isNull() | (F.col("category") == F.col("__category")))
    else:
        rows = search.detector(rows.where("category IS NULL").drop("category", "track_id").withColumnRenamed("__category", "category"))
    log_path = f"{search.path}/log/step={step}"
    rows.select("experiment", "sample_id", "chunk_id", "frame_id", "track_id").write.mode("overwrite").parquet(log_path)
    new = spark.read.schema(LOG).parquet(log_path)
    state = f"{search.path}/state/step={step}"
    keys = ["experiment", "chunk_id"]
    sightings = new.where(F.col("track_id").isNotNull()).groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("n"))
    search.seen().unionByName(sightings).groupBy(*keys, "track_id").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{state}/seen")
    per_frame = new.groupBy(*keys, "frame_id").agg(F.count("track_id").alias("k"))
    frames = per_frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), F.sum("k").alias("n_hits"), F.count_if(F.col("k") > 0).alias("n_hit_frames"))
    counts = ("n_frames", "n_hits", "n_hit_frames")
    search.looked().unionByName(frames).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts]).write.mode("overwrite").parquet(f"{state}/looked")
    search.steps += 1
    return True


def run(search: Search, max_steps: int | None = None) -> DataFrame:
    """Advance until every experiment has met its stop rule; returns the sampling log."""
    while (max_steps is None or search.steps < max_steps) and advance(search):
        pass
    return search.log()


def history(log: DataFrame, experiments: DataFrame, batch: int) -> DataFrame:
    """(experiment, category, scorer, seq, nf, ni): the start, and the state before and after each batch with news."""
    nf = log.groupBy("experiment").agg(F.count_distinct("sample_id").alias("__nf"))
    first = log.where(F.col("track_id").isNotNull()).groupBy("experiment", "track_id").agg(F.min("sample_id").alias("s"))
    news = first.groupBy("experiment", F.floor(F.col("s") / batch).alias("b")).agg(F.count(F.lit(1)).alias("new"))
    curve = running(news, [F.col("b")], block_of(F.col("b")), by=["experiment"], value=F.col("new"), name="ni").join(nf, "experiment")
    state = lambda seq, at, ni: F.struct(seq.cast("long").alias("seq"), at.cast("long").alias("nf"), ni.cast("long").alias("ni"))
    b = F.col("b")
    around = curve.select("experiment", F.inline(F.array(
        state(2 * b + 1, b * batch, F.col("ni") - F.col("new")), state(2 * b + 2, F.least((b + 1) * batch, F.col("__nf")), F.col("ni")))))
    begin = nf.select("experiment", state(F.lit(0), F.lit(0), F.lit(0)).alias("s")).select("experiment", "s.*")
    return begin.unionByName(around).join(experiments.select("experiment", "category", "scorer"), "experiment").select(
        "experiment", "category", "scorer", "seq", "nf", "ni")


def invariants(search: Search, queues: DataFrame) -> DataFrame:
    """What holds for every search, per experiment, recounted from the whole log.

    (experiment, frames_twice, queue_gaps, ids_skipped, reached, overrun): frames sampled more than once, picks
    that do not follow their chunk's queue, sample ids left out, whether the wanted number of objects
    was found, and whether it had been found a batch before the end already.
    """
    log = search.log()
    frames = log.where(F.col("track_id").isNull()).join(search.config(), "experiment").join(queues, ["order_id", "chunk_id", "frame_id"], "left")
    twice = frames.groupBy("experiment", "frame_id").agg(F.count(F.lit(1)).alias("n")).groupBy("experiment").agg(F.count_if(F.col("n") > 1).alias("frames_twice"))
    # Positions of a chunk are distinct when no frame comes twice, so 0 … n-1 without gaps means: the largest is n-1.
    per_chunk = frames.groupBy("experiment", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))
    gaps = per_chunk.groupBy("experiment").agg(F.sum(F.col("last") - F.col("n") + 1).alias("queue_gaps"), F.sum("n").alias("nf"))
    ids = frames.groupBy("experiment").agg((F.max("sample_id") + 1 - F.count_distinct("sample_id")).alias("ids_skipped"))
    first = log.where(F.col("track_id").isNotNull()).groupBy("experiment", "track_id").agg(F.min("sample_id").alias("s"))
    counted = first.join(gaps.select("experiment", "nf"), "experiment").groupBy("experiment").agg(
        F.count(F.lit(1)).alias("ni"), F.count_if(F.col("s") < F.floor((F.col("nf") - 1) / search.batch) * search.batch).alias("before"))
    stop = search.stop
    total = F.coalesce("total_ni", F.lit(0))
    want = total if stop.results is None else F.least(total, F.ceil(total * F.lit(stop.results)) if isinstance(stop.results, float) else F.lit(stop.results))
    return (search.config().join(twice, "experiment").join(gaps, "experiment").join(ids, "experiment").join(counted, "experiment", "left")
            .join(search.read("totals"), "category", "left")
            .select("experiment", "frames_twice", "queue_gaps", "ids_skipped", (F.coalesce("ni", F.lit(0)) >= want).alias("reached"),
                    (F.coalesce("before", F.lit(0)) >= want).alias("overrun")))

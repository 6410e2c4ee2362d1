"""Evaluation tables over result histories: savings against a reference method, costs, summaries.

A record is one history row: task and method columns, ``experiment_id``, ``ni``, ``nf`` and totals.
Every table first takes one number per experiment, so later groups hold one row per repetition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOTAL_OF = {"ni": "total_ni", "nf": "total_nf"}


def geometric_mean(col) -> Column:
    return F.exp(F.avg(F.log(col)))


def _first_reach(records: DataFrame, keys: Sequence[str], fixed: str, levels: Sequence[float], measured: str,
                 relative: bool) -> DataFrame:
    """Least measured value at which every experiment has reached each level, all levels in one pass."""
    one = lambda l: F.struct(
        F.lit(float(l)).alias("rel_level"),
        (F.rint(F.lit(float(l)) * F.col(TOTAL_OF[fixed])).cast("long") if relative and 0 < l < 1 else F.lit(l)).cast("double").alias("level"),
    )
    reached = F.filter(F.array(*map(one, levels)), lambda s: F.col(fixed) >= s["level"])
    rows = records.withColumn("__reached", reached).select(*keys, "experiment_id", F.col(measured).alias("__m"), F.inline("__reached"))
    return rows.groupBy(*keys, "experiment_id", "rel_level", "level").agg(F.min("__m").alias("metric"))


def savings_at(records: DataFrame, task_keys: Sequence[str], method_key: str, fixed: str, levels: Sequence[float],
               measured: str, quantiles: Sequence[float] = (0.1, 0.5, 0.9), reference: str = "random",
               relative: bool = False) -> DataFrame:
    """Savings of each method against a reference method at given levels.

    Per experiment: the least ``measured`` over rows with ``fixed`` >= level.  Across experiments:
    lower, mid and upper quantile.  ``ratio`` is (ref+1)/(mid+1), inverted when ``ni`` is measured,
    null where the task has no reference.  ``relative`` levels in (0, 1) are fractions of the total.
    """
    runs = _first_reach(records, [*task_keys, method_key], fixed, levels, measured, relative)
    mids = runs.groupBy(*task_keys, method_key, "rel_level", "level").agg(
        F.percentile("metric", F.array(*map(F.lit, quantiles))).alias("__q")
    ).select(*task_keys, method_key, "rel_level", "level",
             *[F.col("__q")[i].alias(n) for i, n in enumerate(("lower", "metric", "upper"))])
    w = Window.partitionBy(*task_keys, "rel_level", "level")
    is_ref = F.col(method_key) == reference
    ref = F.when(F.count_if(is_ref).over(w) > 1, F.raise_error(F.lit("more than one reference row in a task"))).otherwise(
        F.max(F.when(is_ref, F.col("metric"))).over(w))
    ratio = (F.col("ref") + 1) / (F.col("metric") + 1)
    if measured == "ni":
        ratio = (F.col("metric") + 1) / (F.col("ref") + 1)
    return mids.withColumn("ref", ref).withColumn("ratio", ratio)


def run_savings(records: DataFrame, keys: Sequence[str], fixed: str, levels: Sequence[float], compare: str, relative_to: str) -> DataFrame:
    """Per experiment: baseline over its own value, the baseline being the reference method's median."""
    runs = _first_reach(records, [*keys, "method"], fixed, levels, compare, relative=False)
    base = runs.where(F.col("method") == relative_to).groupBy(*keys, "level").agg(F.median("metric").alias("baseline"))
    return runs.join(base, [*keys, "level"], "left").withColumn("savings", F.col("baseline") / F.col("metric")).drop("rel_level")


def method_table(records: DataFrame, keys: Sequence[str], fixed: str, level: float, compare: str, methods: Sequence[str],
                 at_least: int = 5, relative_to: str | None = None) -> DataFrame:
    """Geometric mean per task, one column per method; cells of fewer than ``at_least`` runs are null."""
    runs = _first_reach(records, [*keys, "method"], fixed, [level], compare, relative=False)
    agg = runs.groupBy(*keys).pivot("method", list(methods)).agg(
        F.when(F.count(F.lit(1)) >= at_least, geometric_mean("metric")).alias("g"))
    if relative_to is None:
        return agg
    return agg.select(*keys, *[(F.col(f"`{relative_to}`") / F.col(f"`{m}`")).alias(m) for m in methods])


def spread_by(rows: DataFrame, keys: Sequence[str], col: str = "ratio") -> DataFrame:
    """Smallest, median and largest savings per group, with the number of classes."""
    return rows.groupBy(*keys).agg(F.min(col).alias("min_savings"), F.median(col).alias("median_savings"),
                                   F.max(col).alias("max_savings"), F.count(F.lit(1)).alias("num_classes"))


def with_geomean_rows(rows: DataFrame, keys: Sequence[str], over: str, value: str) -> DataFrame:
    """The rows plus, per ``keys``, one row whose ``over`` is ``geomean``: two grouping sets of one pass."""
    gm = rows.groupingSets([[*keys, over], list(keys)], *keys, over).agg(
        geometric_mean(value).alias(value), F.grouping(over).alias("__g"))
    return gm.withColumn(over, F.when(F.col("__g") == 1, "geomean").otherwise(F.col(over))).drop("__g")


def scan_equivalent(records: DataFrame, scanned: DataFrame, scan_rate: float, sample_rate: float, method: str) -> DataFrame:
    """Recall that sampling reaches in the time a full scan needs.

    ``scanned`` has (dataset, frames); the budget is frames/scan_rate·sample_rate sampled frames.
    """
    budgets = scanned.withColumn("scan_time", F.col("frames") / scan_rate).withColumn("random_eq", F.col("scan_time") * sample_rate)
    within = records.where(F.col("method") == method).join(budgets, "dataset").where(F.col("nf") <= F.col("random_eq"))
    best = within.groupBy("dataset", "object_class", "experiment_id").agg(
        F.max("ni").alias("ni"), F.max("nf").alias("nf"), F.max("total_ni").alias("total_ni"), F.max("total_nf").alias("total_nf"),
        F.first("scan_time").alias("scan_time"), F.first("random_eq").alias("random_eq"))
    med = best.groupBy("dataset", "object_class").agg(
        F.median("ni").alias("ni"), F.median("nf").alias("nf"), F.max("total_ni").alias("total_ni"), F.max("total_nf").alias("total_nf"),
        F.max("scan_time").alias("scan_time"), F.max("random_eq").alias("random_eq"))
    return med.select("*", (F.col("ni") / F.col("total_ni")).alias("recall"), (F.col("nf") / sample_rate).alias("total_sec"),
                      (F.col("nf") / F.col("total_nf")).alias("fraction_data"))


def found_within(records: DataFrame, frames_budget: float, keys: Sequence[str]) -> DataFrame:
    """Most objects each experiment found within a frame budget."""
    return records.where(F.col("nf") <= frames_budget).groupBy(*keys, "experiment_id").agg(F.max("ni").alias("max_ni"))


def with_costs(records: DataFrame, phases: DataFrame, proxy_methods: Sequence[str]) -> DataFrame:
    """Total seconds: fixed phases for proxy methods plus frames over the sampling rate.

    ``phases`` has one row per (dataset, phase) with ``xput`` and ``est_seconds``.
    """
    pick = lambda phase, col: F.max(F.when(F.col("phase") == phase, F.col(col)))
    costs = phases.groupBy("dataset").agg(pick("sample", "xput").alias("sample_xput"), *[
        pick(p, "est_seconds").alias(p) for p in ("label", "train", "score")])
    fixed = (F.col("score") + F.col("train") + F.col("label")) * F.col("method").isin(list(proxy_methods)).cast("int")
    return records.join(costs, "dataset").withColumn("overhead", fixed).withColumn(
        "sample_time", F.col("nf") / F.col("sample_xput")).withColumn("total_time", F.col("overhead") + F.col("sample_time"))


def phase_estimates(timings: DataFrame, total_frames: Column, train_frames: int = 120000, epochs: int = 1,
                    sample_share: float = 0.1) -> DataFrame:
    """Seconds per phase at the measured rate: whole frames of the phase over frames per second."""
    rest = total_frames - train_frames
    frames = (F.when(F.col("phase") == "label", F.lit(train_frames)).when(F.col("phase") == "train", F.lit(epochs * train_frames))
              .when(F.col("phase") == "score", rest).when(F.col("phase") == "sample", rest * sample_share).cast("double"))
    return timings.withColumn("xput", F.col("nframes") / F.col("duration")).withColumn("total_frames", frames).withColumn(
        "est_seconds", F.floor(F.col("total_frames") / F.col("xput")).cast("long"))


# Task, frames per second, share of frames the proxy method and random sampling touch.
TASK_RATES = (
    ("expensive inference", 20.0, 0.1, 0.0),
    ("scanning+cheap inference", 100.0, 1.0, 0.0),
    ("random access + decode", 20.0, 0.0001, 0.01),
)


def proxy_cost_table(collections: DataFrame, frames: str = "frames") -> DataFrame:
    """Frames and seconds per task for a proxy method and for random sampling."""
    tasks = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(r).alias("rate"), F.lit(p).alias("fp"), F.lit(q).alias("fr"))
                      for t, r, p, q in TASK_RATES])
    rows = collections.select("*", F.inline(tasks))
    fp, fr = F.col("fp") * F.col(frames), F.col("fr") * F.col(frames)
    return rows.select(*collections.columns, "task", "rate", fp.alias("frames_proxy"), (fp / F.col("rate")).alias("time_proxy"),
                       fr.alias("frames_random"), (fr / F.col("rate")).alias("time_random"))


def savings_quantiles(runs: DataFrame, keys: Sequence[str], best: str, metric: str) -> DataFrame:
    """q2/q5/q8 of savings per class, geomean rows over classes, and an order key by the best method's savings."""
    q = runs.groupBy(*keys, "object_class").agg(F.percentile("savings", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).alias("__q"))
    q = q.select(*keys, "object_class", *[F.col("__q")[i].alias(n) for i, n in enumerate(("q2", "q5", "q8"))])
    gm = q.groupBy(*keys).agg(geometric_mean("q5").alias("q5")).withColumn("object_class", F.lit("geomean"))
    table = q.unionByName(gm, allowMissingColumns=True)
    over_levels = table.where((F.col("method") == best) & (F.col("metric") == metric)).groupBy("dataset", "object_class").agg(
        geometric_mean("q5").alias("__g"))
    # One row per (dataset, class): a short table.
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("dataset").desc(), (F.col("object_class") == "geomean").desc(), F.col("__g").desc(), "object_class")
    ranked = over_levels.withColumn("order_key", (F.dense_rank().over(w) - 1).cast("long")).drop("__g")
    return table.join(ranked, ["dataset", "object_class"], "left")


def renormalize(table: DataFrame, keys: Sequence[str], method: str, cols: Sequence[str]) -> DataFrame:
    """Divide the columns by those of one method inside each key."""
    ref = table.where(F.col("method") == method).select(*keys, *[F.col(c).alias(f"__{c}") for c in cols])
    return table.join(ref, list(keys)).select(*keys, "method", *[(F.col(c) / F.col(f"__{c}")).alias(c) for c in cols])


def side_by_side(table: DataFrame, keys: Sequence[str], a: str, b: str, value: str = "q5") -> DataFrame:
    """Two methods as columns with their ratio."""
    wide = table.groupBy(*keys).pivot("method", [a, b]).agg(F.max(value))
    return wide.withColumn("ratio", F.col(f"`{a}`") / F.col(f"`{b}`"))


def rank_rows(rows: DataFrame, by: Sequence[str], col: str, name: str, tie: Sequence[str]) -> DataFrame:
    """0-based rank, largest first, of summary rows (few per group)."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(col).desc(), *tie)
    return rows.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """First ``k`` rows per group; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def recode(col, names: Mapping[str, str]) -> Column:
    """Rename by dictionary, unknown names stay."""
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    return F.coalesce(lookup[F.col(col)], F.col(col))


def config_grid(spark, **axes) -> DataFrame:
    """Every combination of named parameter values with a readable method name.

    Built by unfolding one value list after the other from a single row.
    """
    grid = spark.range(1)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(str(v)) for v in values])))
    return grid.drop("id").withColumn("method", F.concat_ws("_", *axes))


def experiments_per_key(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    return records.groupBy(*keys).agg(F.count_distinct("experiment_id").alias("experiments"))

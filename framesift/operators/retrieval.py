"""Query by example: linear models over patch embeddings, frame scores, feedback rounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.ordinal import hex_unit, seed_key
from framesift.session import cut_lineage

Model = tuple[list[float], float]


def frame_features(patches: DataFrame, frame: str = "frame_id", vector: str = "embedding") -> DataFrame:
    """Mean vector of every frame's patches; partial sums meet, never the patches."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    return patches.groupBy(frame).agg(vector_to_array(Summarizer.mean(v)).alias("feature"))


def balanced_weights(rows: DataFrame, label: str = "y") -> DataFrame:
    """Adds weight n/(2·n_class), which gives both classes the same pull."""
    n = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) > 0).alias("pos")).alias("s"))
    s = rows.withColumn("__s", n.scalar())
    own = F.when(F.col(label) > 0, F.col("__s.pos")).otherwise(F.col("__s.n") - F.col("__s.pos"))
    return s.withColumn("weight", F.col("__s.n") / (2 * own)).drop("__s")


def positive_weight(rows: DataFrame, label: str = "y", pooled_by: str | None = None) -> DataFrame:
    """Weight of a positive against a negative, per patch or per image after pooling by maximum."""
    if pooled_by:
        rows = rows.groupBy(pooled_by).agg(F.max(label).alias(label))
    pos = F.count_if(F.col(label) > 0)
    return rows.agg(((F.count(F.lit(1)) - pos) / pos).alias("pos_weight"))


def fit(labelled: DataFrame, feature: str, label: str = "y", c: float = 1.0, iterations: int = 100) -> Model:
    """Class-balanced logistic regression; the penalty is 1/c per row."""
    rows = balanced_weights(labelled, label).select(
        array_to_vector(F.col(feature).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"), "weight")
    n = labelled.count()
    model = LogisticRegression(weightCol="weight", regParam=1.0 / (c * n), standardization=False, maxIter=iterations).fit(rows)
    return list(map(float, model.coefficients)), float(model.intercept)


def dot(vector: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(vector, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def probability(vector: Column, model: Model) -> Column:
    """Positive probability as a plain expression: no Python worker, no model object in the plan."""
    weights, intercept = model
    return sigmoid(dot(vector.cast("array<double>"), F.array(*[F.lit(w) for w in weights])) + F.lit(intercept))


def score_frames(patches: DataFrame, model: Model, frame: str = "frame_id", vector: str = "embedding") -> DataFrame:
    """Mean patch probability per frame."""
    return patches.groupBy(frame).agg(F.avg(probability(F.col(vector), model)).alias("score"))


def score_many(patches: DataFrame, models: DataFrame, vector: str = "embedding", keys: Sequence[str] = ("patch_id",)) -> DataFrame:
    """(keys…, model_id, probability) for a table of linear models; a model without weights gives 0.

    Models (model_id, weights, intercept) are one short array beside every row.
    """
    listed = models.agg(F.collect_list(F.struct("model_id", "weights", "intercept"))).scalar()
    rows = patches.select(*keys, F.col(vector).cast("array<double>").alias("__v"), F.explode(listed).alias("m"))
    p = F.when(F.col("m.weights").isNull(), 0.0).otherwise(sigmoid(dot(F.col("__v"), F.col("m.weights")) + F.col("m.intercept")))
    return rows.select(*keys, F.col("m.model_id").alias("model_id"), p.alias("probability"))


def fit_per_label(rows: DataFrame, feature: str, labels: Sequence[str], **options) -> list[tuple[str, list[float] | None, float]]:
    """One model per label column; labels without positives get none."""
    counts = rows.agg(*[F.sum(label).alias(label) for label in labels]).first()
    models = []
    for label in labels:
        if not counts[label]:
            models.append((label, None, 0.0))
        else:
            models.append((label, *fit(rows, feature, label, **options)))
    return models


MODEL_SCHEMA = "model_id string, weights array<double>, intercept double"


def decide(probabilities: DataFrame, last_label: str, keys: Sequence[str] = ("patch_id",)) -> DataFrame:
    """Final decision: the last label's probability above one half."""
    return probabilities.where(F.col("model_id") == last_label).select(*keys, (F.col("probability") > 0.5).alias("positive"))


def normalise(rows: DataFrame, vector: str = "embedding", name: str = "normal") -> DataFrame:
    """(x − mean)/std per dimension, population deviation; constant dimensions give 0."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    summary = rows.select(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")).select(
        F.struct(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"), F.col("s.count").alias("n")).alias("s"))
    with_stats = rows.withColumn("__s", summary.scalar())
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.col("__s.mean"), lambda x, m: x - m)
    deviation = F.transform("__s.var", lambda q: F.sqrt(q * (F.col("__s.n") - 1) / F.col("__s.n")))
    return with_stats.withColumn(name, F.zip_with(centred, deviation, lambda x, s: F.when(s > 0, x / s).otherwise(F.lit(0.0)))).drop("__s")


def feedback_round(patches: DataFrame, features: DataFrame, truth: DataFrame, seen: DataFrame | None, batch: int, number: int,
                   seed=0) -> DataFrame:
    """Next ``batch`` frames to label: (frame_id, y, round).

    Random while nothing positive is labelled; afterwards the best unseen frames by a model
    refitted on what is labelled.  The batch is a bounded top-k.
    """
    if seen is None or seen.where("y > 0").isEmpty():
        scored = features.select("frame_id", hex_unit(seed_key(f"{seed}-{number}", "frame_id")).alias("score"))
    else:
        labelled = features.join(seen.select("frame_id", "y"), "frame_id")
        scored = score_frames(patches, fit(labelled, "feature"))
    if seen is not None:
        scored = scored.join(seen.select("frame_id"), "frame_id", "left_anti")
    best = scored.orderBy(F.col("score").desc(), "frame_id").limit(batch)
    return best.join(truth, "frame_id").select("frame_id", "y", F.lit(number).alias("round"))


def search_by_example(patches: DataFrame, truth: DataFrame, wanted: int, batch: int = 9, seed=0, max_rounds: int | None = None) -> DataFrame:
    """Feedback rounds until ``wanted`` positives are labelled or frames run out: (frame_id, y, round)."""
    features = cut_lineage(frame_features(patches), "features")
    seen, number = None, 0
    while max_rounds is None or number < max_rounds:
        new = feedback_round(patches, features, truth, seen, batch, number, seed)
        seen = cut_lineage(new if seen is None else seen.unionByName(new), "seen")
        tally = seen.agg(F.sum("y"), F.count_if(F.col("round") == number)).first()
        number += 1
        if tally[0] >= wanted or tally[1] == 0:
            break
    return seen


def position_of(seen: DataFrame, wanted: int) -> DataFrame:
    """Labelled frames it took to reach the ``wanted``-th positive; whole rounds count in frame order."""
    from framesift.functions.ordinal import positions

    ranked = positions(seen, [F.col("round"), F.col("frame_id")])
    hits = positions(ranked.where("y > 0"), [F.col("pos")], name="nth")
    return hits.where(F.col("nth") == wanted - 1).select((F.col("pos") + 1).alias("frames"))

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.operators import retrieval as R


def clusters(spark, frames=40, per=3, seed=0):
    """Frames with a positive cluster far from the rest."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(frames):
        y = int(f % 8 == 0)
        for k in range(per):
            rows.append((f * per + k, f, [float(v) for v in rng.normal(size=3) + (3 if y else 0)], y))
    return spark.createDataFrame(rows, "patch_id long, frame_id long, embedding array<double>, y int")


def test_fit_solves_the_balanced_penalised_problem(spark):
    df = clusters(spark)
    weights, intercept = R.fit(df, "embedding", c=0.5)
    rows = df.collect()
    x, y = np.array([r.embedding for r in rows]), np.array([r.y for r in rows])
    n, pos = len(y), y.sum()
    w = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    p = 1 / (1 + np.exp(-(x @ weights + intercept)))
    # Gradient of 0.5·|β|² + c·Σ w·loss vanishes at the solution.
    slope = np.array(weights) + 0.5 * ((p - y) * w) @ x
    assert np.abs(slope).max() < 0.05 and abs(((p - y) * w).sum()) < 0.05


def test_many_models_equal_one_by_one(spark):
    df = clusters(spark)
    models = [("a", [0.1, -0.2, 0.3], 0.5), ("none", None, 0.0), ("b", [1.0, 0.0, -1.0], -0.1)]
    got = {(r.patch_id, r.model_id): r.probability for r in R.score_many(df, spark.createDataFrame(models, R.MODEL_SCHEMA)).collect()}
    for r in df.collect():
        for name, w, b in models:
            want = 0.0 if w is None else 1 / (1 + np.exp(-(np.dot(r.embedding, w) + b)))
            assert got[(r.patch_id, name)] == pytest.approx(want)


def test_labels_without_positives_get_no_model(spark):
    df = clusters(spark).withColumn("never", F.lit(0))
    fitted = R.fit_per_label(df, "embedding", ["never", "y"])
    assert fitted[0][1] is None and len(fitted[1][1]) == 3
    p = R.score_many(df, spark.createDataFrame(fitted, R.MODEL_SCHEMA))
    agree = R.decide(p, "y").join(df, "patch_id").agg(F.avg((F.col("positive").cast("int") == F.col("y")).cast("int"))).first()[0]
    assert agree > 0.9


def test_search_by_example_finds_all_positives_early(spark):
    df = clusters(spark)
    truth = df.groupBy("frame_id").agg(F.max("y").alias("y"))
    seen = R.search_by_example(df, truth, wanted=5, batch=5)
    assert seen.agg(F.sum("y")).first()[0] == 5
    assert seen.select("frame_id").distinct().count() == seen.count() <= 30
    assert R.position_of(seen, 5).first()[0] <= seen.count()
    again = R.search_by_example(df, truth, wanted=5, batch=5)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in seen.collect()}

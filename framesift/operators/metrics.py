"""Ranking and detection metrics.  Equal scores are folded first, then walked by running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.functions.ordinal import exact_quantiles, running, sampled_bucket
from framesift.operators.detections import best_overlaps, suppress


def precision_in_top(rows: DataFrame, truth: str, score: str, k: int, tie: str) -> DataFrame:
    top = rows.orderBy(F.col(score).desc(), tie).limit(k)
    return top.agg((F.sum(truth) / k).alias("precision"))


def _score_groups(rows: DataFrame, truth: str, score: str, by: Sequence[str]) -> DataFrame:
    """Per distinct score: rows, truth sum and both totals over scores at least as high."""
    by = list(by)
    g = rows.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(truth).cast("double").alias("gain"))
    order = [-F.col(score)]
    return running(g, order, sampled_bucket(rows, order), by=by, value={"cum_n": F.col("n"), "cum_gain": F.col("gain")})


def average_precision(rows: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times recall step over distinct scores; ties share one step."""
    g = _score_groups(rows, truth, score, by)
    return g.groupBy(*by).agg(
        (F.sum(F.col("gain") * F.col("cum_gain") / F.col("cum_n")) / F.sum("gain")).alias("average_precision"))


def _dcg(rows: DataFrame, truth: str, score: str, k: int, by: Sequence[str], name: str) -> DataFrame:
    g = _score_groups(rows, truth, score, by).withColumn("__lo", F.col("cum_n") - F.col("n")).where(F.col("__lo") < k)
    ranks = F.sequence(F.col("__lo"), F.least(F.col("cum_n"), F.lit(k)) - 1)
    discount = F.aggregate(F.transform(ranks, lambda r: 1 / F.log2(r + 2)), F.lit(0.0), lambda a, x: a + x)
    return g.groupBy(*by).agg(F.sum(F.col("gain") / F.col("n") * discount).alias(name))


def ndcg(rows: DataFrame, truth: str, score: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """nDCG@k; tied scores share the mean gain of their group."""
    by = list(by)
    got = _dcg(rows, truth, score, k, by, "dcg")
    best = _dcg(rows, truth, truth, k, by, "ideal")
    both = got.join(best, by) if by else got.withColumn("ideal", best.scalar())
    return both.select(*by, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg"))


def pooled(rows: DataFrame, image: str, truth: str, score: str) -> DataFrame:
    """Largest truth and score over the patches of every image."""
    return rows.groupBy(image).agg(F.max(truth).alias(truth), F.max(score).alias(score))


def match_summary(predicted: DataFrame, truth: DataFrame, by: Sequence[str], key: str, truth_key: str, score: str,
                  above: float) -> tuple[DataFrame, DataFrame]:
    """Predictions flagged ``matched`` (best IoU above the limit), truths with ``target_score``.

    A truth's score is the best score among predictions whose IoU with it is above the limit, 0 if none.
    """
    best = best_overlaps(predicted, truth.withColumn("__one", F.lit(1.0)), by, key, "__one", above)
    out = predicted.join(best.select(key, "best_iou"), key, "left").withColumn("matched", F.coalesce(F.col("best_iou") > above, F.lit(False)))
    covered = best_overlaps(truth, predicted, by, truth_key, score, above)
    targets = truth.join(covered.select(truth_key, "best_score", F.col("best_iou").alias("truth_iou")), truth_key, "left")
    targets = targets.withColumn("target_score", F.coalesce("best_score", F.lit(0.0))).withColumn(
        "found", F.coalesce(F.col("truth_iou") > above, F.lit(False))).drop("best_score", "truth_iou")
    return out.drop("best_iou"), targets


def precision_at_recall(predicted: DataFrame, targets: DataFrame, score: str, recalls: Sequence[float]) -> DataFrame:
    """Cut-off, precision and recall for wanted recalls: the cut-off is the lower (1−r) quantile of truth scores."""
    cuts = exact_quantiles(targets, "target_score", [1 - r for r in recalls], interpolation="lower")
    listed = cuts.agg(F.collect_list(F.struct(F.round(1 - F.col("q"), 9).alias("level"), F.col("value").alias("cutoff"))))
    p = predicted.withColumn("c", F.explode(listed.scalar())).where(F.col(score) > F.col("c.cutoff"))
    p = p.groupBy("c").agg(F.count(F.lit(1)).alias("ap"), F.count_if("matched").alias("tp"))
    t = targets.withColumn("c", F.explode(listed.scalar())).groupBy("c").agg(
        (F.count_if(F.col("target_score") > F.col("c.cutoff")) / F.count(F.lit(1))).alias("recall"))
    return t.join(p, "c", "left").select("c.level", "c.cutoff", (F.col("tp") / F.col("ap")).alias("precision"), "recall")


def box_metrics(predicted: DataFrame, truth: DataFrame, image: str, key: str, truth_key: str, score: str,
                score_above: float = 0.01, nms_limit: float = 0.5, matched_above: float = 0.5) -> DataFrame:
    """Per image: proposals after suppression, how many match, truths, how many are found, best raw score."""
    kept = suppress(predicted.where(F.col(score) > score_above), nms_limit, score, [image], key).where("kept")
    out, targets = match_summary(kept, truth, [image], key, truth_key, score, matched_above)
    raw = predicted.groupBy(image).agg(F.max(score).alias("max_score"))
    props = out.groupBy(image).agg(F.count(F.lit(1)).alias("total_proposals"), F.count_if("matched").alias("matched_proposals"))
    trues = targets.groupBy(image).agg(F.count(F.lit(1)).alias("total_true"), F.count_if("found").alias("matched_true"))
    counts = ["total_proposals", "matched_proposals", "total_true", "matched_true"]
    return raw.join(props, image, "full").join(trues, image, "full").fillna(0, counts)

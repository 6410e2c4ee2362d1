"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.session import cut_lineage

#: Keys that hold at least one row in so many count as hot; so there are at most that many hot keys.
HOT_SHARE = 1000


def arrow_batches(spark: SparkSession, size: str = "16m") -> None:
    """Bound Arrow batches by bytes, so that a batch of very long texts stays small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str = "doc_id", folds: int = 5) -> Column:
    """Fold of a row by the CRC-32 of its id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def held_out(key: str = "doc_id") -> Column:
    return fold(key) == 0


def bounded(rows: DataFrame, order: Column, most: int, total: int | None = None) -> DataFrame:
    """The first ``most`` rows along ``order``, a 64-bit hash.

    Partial top rows per task, so nothing larger meets in one place.  With ``total``, about the number of
    ``rows`` there are, those whose hash is far beyond what is wanted are dropped where they are read,
    so that what the tasks pass on does not grow with their number.
    """
    if total and total > 16 * most:
        rows = rows.where(order < F.lit(-(1 << 63) + int((1 << 64) * (8 * most / total))))
    return rows.orderBy(order).limit(most)


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Inner join on ``key`` where few keys may hold most of ``left``.

    ``right`` has one row per key with the number ``rows`` of left rows it meets.  Keys with at least
    ``total / HOT_SHARE`` left rows number at most HOT_SHARE, so their right rows are broadcast and
    the hot left rows stay where they are; all others are shuffled, and no key there is large.
    """
    limit = max(1000, -(-total // HOT_SHARE))
    hot = F.broadcast(right.where(F.col(rows) >= limit))
    cold = right.where(F.col(rows) < limit)
    return left.join(hot, key).unionByName(left.join(cold, key))


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges`` (u long, v long): one row (node, root) per node.

    ``root`` is the smallest node of the component.  Large-star and small-star steps in turn until
    every edge points at its root: each is a partial minimum per node and a join with it, so a node
    with very many edges is folded before the shuffle and its join can be split.  Every round is
    written to the shared folder, which cuts the lineage.
    """
    u, v = F.col("u"), F.col("v")

    def star(pairs: DataFrame, around: DataFrame, large: bool) -> DataFrame:
        lowest = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = pairs.join(lowest, "u")
        moved = met.where(v > u).select(v.alias("u"), F.col("m").alias("v")) if large else met.select(v.alias("u"), F.col("m").alias("v"))
        own = lowest.select("u", F.col("m").alias("v"))
        return moved.unionByName(own).where(u != v).distinct()

    down = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(u != v).distinct()
    edges = cut_lineage(down(edges), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        wide = star(both, both, True)
        edges = cut_lineage(star(down(wide), down(wide), False), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(u.alias("node"), v.alias("root")).unionByName(edges.select(v.alias("node"), v.alias("root")).distinct())

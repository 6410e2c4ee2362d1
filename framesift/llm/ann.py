"""Nearest neighbours by inner product with multi-index hashing over learned binary codes.

Codes: inner product becomes angle by one more coordinate that fills every vector up to the largest
norm; vectors are centred, turned to their principal axes and then by the rotation that makes
their signs fit best (iterative quantisation), and the signs are the code.  Mean, axes and rotation
are learned on a bounded sample; every vector is coded and indexed.

Search: the vectors are dealt to shards of bounded size.  A shard cuts its codes into substrings of
16 bits and keeps a table from value to vectors for each.  A code within Hamming radius r of a query
lies within the substring's share of r for at least one substring (the shares add up to r plus one
less the number of substrings), so probing each table within its share retrieves every code within
r.  What is retrieved is checked by its whole code and ranked by the exact inner product.  The
radius is learned on the sample as well; where a shard holds fewer codes within it than neighbours
are wanted, the radius grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.common import bounded
from framesift.session import cut_lineage

#: Longest code, bits of a substring, vectors in a shard, vectors in the learning sample and its bytes.
BITS, PART, SHARD, SAMPLE, SAMPLE_BYTES = 64, 16, 16_384, 10_000, 32 << 20
#: Share of the sample's true neighbours that the learned radius must cover, and sample queries for it.
COVER, PROBES = 0.96, 512
ROUNDS, SEED = 30, 3


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; very large and very small rows are brought to usual sizes before."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Codes:
    """Largest norm, mean, projection to the rotated axes, and the radius to search."""

    norm: float
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def fill(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(axis=1)))
        return np.column_stack([x, rest])

    def sign(self, filled: np.ndarray) -> np.ndarray:
        up = np.zeros((len(filled), BITS), np.uint8)
        up[:, : self.bits] = (filled - self.mean) @ self.turn > 0
        return np.packbits(up, axis=1, bitorder="little").view(np.uint64)[:, 0]

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        return self.sign(self.fill(x))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        """A query has nothing in the filling coordinate and counts by its direction only."""
        return self.sign(np.column_stack([unit(x) * self.norm, np.zeros(len(x))]))


def learn(x: np.ndarray, norm: float, total: int, k: int, bits: int = BITS, seed: int = SEED) -> Codes:
    """Codes from a sample ``x`` of ``total`` vectors with the largest norm ``norm``."""
    codes = Codes(norm, np.zeros(x.shape[1] + 1), np.eye(x.shape[1] + 1, min(bits, x.shape[1])), 0)
    if len(x) < 2:
        codes.radius = codes.bits
        return codes
    filled = codes.fill(x)
    codes.mean = filled.mean(axis=0)
    _, _, axes = np.linalg.svd(filled - codes.mean, full_matrices=False)
    axes = axes[: min(bits, x.shape[1])].T
    z = (filled - codes.mean) @ axes
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))
    for _ in range(ROUNDS):
        u, _, v = np.linalg.svd(np.sign(z @ turn).T @ z)
        turn = (u @ v).T
    codes.turn = axes @ turn
    # Among all vectors the k nearest are as near as the first few of a sample are.
    few = max(1, min(len(x) - 1, round(k * len(x) / max(total, 1))))
    pick = rng.permutation(len(x))[:PROBES]
    x = np.where(np.abs(x).max(axis=1, keepdims=True) > 0, x, 1e-300)
    near = x[pick] @ x.T
    near[np.arange(len(pick)), pick] = -np.inf
    best = np.argpartition(-near, few - 1, axis=1)[:, :few]
    apart = np.bitwise_count(codes.of_queries(x[pick])[:, None] ^ codes.of_vectors(x)[best])
    codes.radius = int(np.quantile(apart, COVER, method="higher"))
    return codes


class Tables:
    """The substring tables of one shard."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        self.parts = []
        for at in range(0, max(1, bits), PART):
            width = min(PART, bits - at) or 1
            value = (codes >> np.uint64(at)) & np.uint64((1 << width) - 1)
            values, entry = np.unique(value, return_inverse=True)
            self.parts.append((at, width, values, entry))

    def probe(self, part: int, query: int, share: int) -> np.ndarray:
        """Which vectors have a substring that differs in at most ``share`` bits, by way of the occupied table entries."""
        at, width, values, entry = self.parts[part]
        value = np.uint64((query >> at) & ((1 << width) - 1))
        return (np.bitwise_count(values ^ value) <= share)[entry]

    def within(self, query: int, radius: int) -> np.ndarray:
        """Every vector whose whole code differs in at most ``radius`` bits."""
        m = len(self.parts)
        spare = radius + 1 - m
        found = np.zeros(len(self.codes), bool)
        for i in range(m):
            share = radius if m == 1 else spare // m + (i < spare % m) if spare >= 0 else 0 if i <= radius else -1
            if share >= 0:
                found |= self.probe(i, query, share)
        some = np.flatnonzero(found)
        return some[np.bitwise_count(self.codes[some] ^ np.uint64(query)) <= radius]


def nearest(x: np.ndarray, rows: np.ndarray, ids: np.ndarray, tables: Tables, codes: Codes, given: np.ndarray, query: np.ndarray, own: int, code: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``x``, ``given``: vectors and query as they are; ``rows`` scaled to usual sizes, ``query`` of length one.  (ids, scores) of the k best retrieved vectors other than ``own``; ties go to the smaller id."""
    radius = codes.radius
    while True:
        some = tables.within(code, radius)
        some = some[ids[some] != own]
        if len(some) >= k or radius >= codes.bits:
            break
        radius = min(codes.bits, radius + max(2, radius // 4))
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0)
    if len(some) > k:
        # A product in single precision, with room for its error, leaves few for the exact one.
        rough = rows[some] @ query.astype(np.float32)
        room = 1e-5 * codes.norm
        some = some[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - room]
    # Summed row by row in one order, so that equal vectors have equal scores.
    score = (x[some] * given).sum(axis=1)
    best = np.lexsort([ids[some], -score])[:k]
    return ids[some[best]], score[best]


def _search(codes: Codes, scale: float, dim: int, k: int):
    """Rows (shard, query, id, vector) sorted by shard, its vectors before the queries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held_x, held_ids, tables, x, single, ids = None, [], [], None, None, None, None
        for b in batches:
            shard, kind, vec = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            rows = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            out: list[tuple[np.ndarray, ...]] = []
            cuts = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]))) if len(shard) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(shard)]):
                if shard[lo] != at:
                    at, held_x, held_ids, tables = shard[lo], [], [], None
                if not kind[lo]:
                    held_x.append(rows[lo:hi])
                    held_ids.append(vec[lo:hi])
                    continue
                if tables is None:
                    if not held_x:
                        continue
                    x, ids = np.concatenate(held_x), np.concatenate(held_ids)
                    held_x, held_ids = [x], [ids]
                    tables, single = Tables(codes.of_vectors(x / scale), codes.bits), (x / scale).astype(np.float32)
                asked = unit(rows[lo:hi])
                for given, q, own, code in zip(rows[lo:hi], asked, vec[lo:hi], codes.of_queries(asked)):
                    got, score = nearest(x, single, ids, tables, codes, given, q, own, int(code), k)
                    out.append((np.full(len(got), own), got, score))
            if out:
                q, v, s = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return work


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part.

    Null ids and vectors, empty and zero vectors, and vectors with a null or non-finite component take
    no part; of vectors of several lengths only those of the most frequent length do (the longer one of two).
    """
    v = F.col("embedding").cast("array<double>")
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", sound) & F.exists("v", lambda c: c != 0))
    width = some.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return some.where(F.size("v") == (width.d if width else 0))


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by ``every`` its ``k`` nearest found.

    Nearness is the largest inner product, in double precision on the vectors given; ties go to the
    smaller id.  Rows with the query's own id are no candidates, repeated ones included; a repeated query is
    one query; other repeated rows are candidates as often as they are there.  Fewer candidates
    than ``k`` all come back.  Empty input gives no rows, and other columns are not read.
    """
    spark = vectors.sparkSession
    some = cut_lineage(usable(vectors), "vectors")
    total, scale, dim = some.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c)))), F.max(F.size("v"))).first()
    norm = some.agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / scale) * (c / scale))))).first()[0] if total else 0.0
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(2, min(sample, SAMPLE_BYTES // (8 * dim)))
    x = np.array([r.v for r in bounded(some, F.xxhash64("vec_id"), most, total).orderBy("vec_id", "v").collect()], float).reshape(-1, dim) / scale
    codes = learn(x, norm, total, k)
    shards = -(-total // shard)
    indexed = some.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = some.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    both = indexed.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(_search(codes, scale, dim, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Quality scores by nearest-neighbour voting in a latent semantic space.

A text's terms are its byte pairs and the shapes of its words and lines, counted in hashed columns.
Counts are damped, weighted by inverse document frequency over the whole corpus, and projected on
the leading singular vectors of a bounded sample of labelled texts.  The sample's vectors are
broadcast (their number and width are parameters); every document is compared with all of them by
blocked products of unit vectors, and the labels of its nearest neighbours vote with weights that
fall with the angle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import bounded
from framesift.session import cut_lineage

#: Hashed term columns, latent dimensions, labelled texts at most, neighbours that vote.
COLUMNS, RANK, MOST, NEIGHBOURS = 2048, 48, 6000, 25
#: Texts compared with the labelled vectors at once.
BLOCK = 512
#: A neighbour's weight is exp(SHARPNESS * (cosine - 1)).
SHARPNESS = 20.0
SEED = 5
_PAIRS = COLUMNS - 256


def _pair_columns() -> np.ndarray:
    """Hashed column of every byte pair."""
    code = np.arange(1 << 16, dtype=np.uint64)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % _PAIRS


PAIR_COLUMN = _pair_columns()


def _level(n: np.ndarray | int) -> np.ndarray:
    """Size class of a count: its binary length, at most 15."""
    return np.minimum(np.ceil(np.log2(np.asarray(n) + 1)), 15).astype(int)


def term_counts(raw: bytes | None) -> np.ndarray:
    """Counts of a text's terms in COLUMNS columns; all zero for a null or empty text."""
    out = np.zeros(COLUMNS, np.float32)
    if not raw or not raw.strip():
        return out
    b = np.frombuffer(raw, np.uint8)
    if len(b) > 1:
        pair = b[:-1].astype(np.int32) * 256 + b[1:]
        out[:_PAIRS] = np.bincount(PAIR_COLUMN[pair], minlength=_PAIRS)
    words = raw.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out[_PAIRS: _PAIRS + 32] = np.bincount(np.minimum(sizes, 31), minlength=32)
    lines = [x.strip() for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    out[_PAIRS + 32: _PAIRS + 48] = np.bincount(_level(np.array([len(x) for x in lines])), minlength=16)
    # Repeated lines, repeated words and the length of the text, as terms of their own.
    share = lambda distinct, n: int(15 * (1 - distinct / n))
    out[_PAIRS + 64 + share(len(set(lines)), len(lines))] = len(lines)
    out[_PAIRS + 80 + share(len(set(words)), len(words))] = len(words)
    out[_PAIRS + 96 + int(_level(len(words)))] = len(words)
    threes = list(zip(words, words[1:], words[2:]))
    if threes:
        out[_PAIRS + 112 + share(len(set(threes)), len(threes))] = len(threes)
    return out


def _damped(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of damped counts times weight; a zero row stays zero."""
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Voters:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = _damped(counts, self.idf) @ self.basis
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours' votes; the prior where there is no vector or no voter."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels) or not len(counts):
            return out
        x = self.project(counts)
        some = np.flatnonzero(np.abs(x).sum(axis=1) > 0)
        cos = x[some] @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.exp(SHARPNESS * (np.take_along_axis(cos, near, axis=1).astype(float) - 1))
        out[some] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0.0, 1.0)


def latent(counts: np.ndarray, labels: np.ndarray, idf: np.ndarray, rank: int = RANK) -> Voters:
    """Voters from the labelled sample: a truncated singular value decomposition by subspace iteration."""
    if not len(labels):
        return Voters(idf, np.zeros((COLUMNS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = _damped(counts, idf)
    rank = max(1, min(rank, *x.shape))
    q = np.random.default_rng(SEED).normal(size=(x.shape[1], min(x.shape[1], rank + 16))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ v[:rank].T).astype(np.float32)
    voters = Voters(idf, basis, np.zeros((0, rank), np.float32), labels.astype(float), float((labels.sum() + 1) / (len(labels) + 2)))
    voters.vectors = voters.project(counts)
    return voters


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of the corpus each column occurs, and the number of texts that have terms.

    Each task sums its own texts; a vector of COLUMNS numbers per task is added up by column.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros(COLUMNS, np.int64), 0
        for b in batches:
            for x in b.column(0):
                c = term_counts(x.as_py())
                seen += c > 0
                texts += bool(c.any())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COLUMNS + 1)), pa.array(np.append(seen, texts))], ["c", "n"])

    sums = docs.select(F.col("text").cast("binary")).mapInArrow(rows, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(COLUMNS + 1, np.int64)
    for r in sums:
        out[r.c] = r.n
    return out[:COLUMNS], int(out[COLUMNS])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Voters:
    """Voters from ``labels`` (doc_id, quality): at most ``most`` labelled ids, the first by a hash of the id.

    Document frequencies come from all of ``docs``.  Several labels of one id are averaged; null
    labels and labels of unknown ids are left out.
    """
    idf = _weights(*document_frequency(docs))
    one = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    some = cut_lineage(bounded(one, F.xxhash64("doc_id"), most, labels.count()), "labelled")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [term_counts(x.as_py()) for x in b.column(2)]
            at = [np.flatnonzero(c).astype(np.int16) for c in counts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([a.tobytes() for a in at], pa.binary()),
                                              pa.array([c[a].tobytes() for a, c in zip(at, counts)], pa.binary())], ["doc_id", "y", "c", "n"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sample = texts.join(F.broadcast(some), "doc_id").select("doc_id", "y", "text").mapInArrow(rows, "doc_id long, y double, c binary, n binary")
    # An id may have many rows: the bound holds for the rows as well.
    got = sorted(cut_lineage(bounded(sample, F.xxhash64("doc_id", "c", "n"), most), "sample").collect(), key=lambda r: (r.doc_id, bytes(r.c), bytes(r.n)))
    counts = np.zeros((len(got), COLUMNS), np.float32)
    for i, r in enumerate(got):
        counts[i, np.frombuffer(r.c, np.int16)] = np.frombuffer(r.n, np.float32)
    return latent(counts, np.array([r.y for r in got]), idf)


def _weights(seen: np.ndarray, texts: int) -> np.ndarray:
    return np.log((1 + texts) / (1 + seen)).astype(np.float32) + np.float32(1)


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """(doc_id, score) for every row of ``docs``: the whole text against all voters.

    An empty, blank or null text, and any text when there are no voters, gets the smoothed share of
    label 1.  Repeated rows come back as often as they are there and a null doc_id stays null; other
    columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, out = b["text"].to_numpy(), np.zeros(len(b))
            for i in range(0, len(b), BLOCK):
                out[i: i + BLOCK] = voters.score(np.array([term_counts(x) for x in texts[i: i + BLOCK]]).reshape(-1, COLUMNS))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": out})

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(rows, f"doc_id {kind}, score double")

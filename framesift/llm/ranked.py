"""Ranked lexical search by sequential reads of impact-sorted lists, without random access (NRA).

Terms are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z in lower case.
Scores are whole numbers: a term's weight falls with the number of documents that hold it, times a
saturating share of its occurrences in the document, which falls with the document's length.

Three passes over a shard of items.  The first counts, per document, its terms and the occurrences of
the items' terms, which is written; the second counts over all documents how many there are, how
long they are and how many hold a term.  In the third each task cuts what it reads into fragments of bounded
size, sorts every term's postings of a fragment by impact, and answers each item there: its lists are read
from the top, every document met has a lower bound (what was read of it) and an upper one (plus the
next unread impact of each list in which it was not met yet).  Reading goes on until no document
that could still belong to the best, equal scores included, has two different bounds.  The best of a
fragment raise the bar for the task's next ones, and the best of all tasks are ranked at last.

Items come in shards of bounded bytes, so that what a task holds of them does not grow with their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.session import cut_lineage

#: Results per item, bytes of item text in a shard, documents and postings of a fragment, first reads per list.
TOP, SHARD_BYTES, DOCUMENTS, POSTINGS, FIRST = 10, 4 << 20, 1 << 15, 1 << 21, 64
#: Share of a document's length in its norm, in per cent.
SLOPE = 75

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    """Terms of UTF-8 bytes, in order and with repeats."""
    return raw.translate(_KEPT).split() if raw else []


@dataclass
class Items:
    """Items of a shard: per item its id, term numbers and how often it holds each; ``vocabulary`` numbers the terms."""

    ids: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    vocabulary: dict[bytes, int]


def read_items(rows: list[tuple]) -> Items:
    out = Items([], [], [], {})
    for item_id, raw in rows:
        counts = Counter(terms(raw))
        if counts:
            out.ids.append(item_id)
            out.terms.append(np.array([out.vocabulary.setdefault(t, len(out.vocabulary)) for t in counts], np.int64))
            out.times.append(np.array(list(counts.values()), np.int64))
    return out


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times): all terms of each document row, and how often it holds each of the vocabulary."""
    size = max(1, len(vocabulary))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hits, sizes = [], [], []
            for raw in b.column(1).to_pylist():
                ts = terms(raw)
                n.append(len(ts))
                found = [vocabulary[t] for t in ts if t in vocabulary]
                hits.append(np.array(found, np.int64))
                sizes.append(len(found))
            flat = np.concatenate(hits) if hits else np.zeros(0, np.int64)
            pair, times = np.unique(np.repeat(np.arange(len(n)), sizes) * size + flat, return_counts=True)
            offsets = pa.array(np.searchsorted(pair, np.arange(len(n) + 1) * size).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array((pair % size).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))], ["doc_id", "n", "terms", "times"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        rows, f"doc_id {kind}, n long, terms array<int>, times array<int>")


def norms(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Length norm of documents with ``n`` terms, in per cent of the average one's."""
    if len(n) and int(n.max()) * SLOPE * documents >= 1 << 63:
        return np.array([100 - SLOPE + SLOPE * int(x) * documents // total for x in n], np.int64)
    return 100 - SLOPE + SLOPE * n * documents // max(1, total)


class Fragment:
    """Impact-sorted postings of some documents: ``doc`` and ``impact`` by term, the largest impact first."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, documents: int, total: int):
        impact = weight[term] * (1_000_000_000 * times // (1000 * times + 8 * norms(n, documents, total)[doc]))
        order = np.lexsort((doc, -impact, term))
        self.size, self.doc, self.impact = len(n), doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.reads = 0

    def best(self, wanted: np.ndarray, times: np.ndarray, top: int, bar: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that can be among the ``top`` best with at least ``bar``; ties of the last stay in."""
        lists = [(self.start[t], self.start[t + 1], q) for t, q in zip(wanted.tolist(), times.tolist()) if self.start[t] < self.start[t + 1]]
        lower = np.zeros(self.size, np.int64)
        depth, step = 0, FIRST
        alive = None
        while True:
            # Every list is read on, a round twice as deep as the one before.
            ahead = []
            upto = depth + step
            for first, end, q in lists:
                a, z = first + depth, min(end, first + upto)
                if a < z:
                    d = self.doc[a:z]
                    self.reads += z - a
                    if alive is None:
                        lower[d] += q * self.impact[a:z]
                    else:  # nothing but the documents that are still open
                        keep = alive[d]
                        lower[d[keep]] += q * self.impact[a:z][keep]
                ahead.append(q * int(self.impact[first + upto]) if first + upto < end else 0)
            depth, step = upto, 2 * step
            unseen = sum(ahead)
            # A document met in a list has nothing more to come from it.
            more = np.full(self.size, unseen, np.int64)
            for (first, end, _), rest in zip(lists, ahead):
                if rest:
                    more[self.doc[first: first + depth]] -= rest
            at_least = max(bar, int(np.partition(lower, -top)[-top]) if self.size >= top else 0, 1)
            if unseen >= at_least:
                continue  # a document not met at all could still be among the best
            alive = lower + more >= at_least if alive is None else alive & (lower + more >= at_least)
            if not more[alive].any():
                docs = np.flatnonzero(alive)
                return docs, lower[docs]


def _local(items: Items, weight: np.ndarray, documents: int, total: int, top: int):
    """Function of the third pass: the best of a task per item."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items.ids]
        held: list[tuple] = []

        def answer() -> None:
            ids = [i for part in held for i in part[0]]
            n = np.concatenate([p[1] for p in held])
            per_doc = np.concatenate([p[2] for p in held])
            term, times = (np.concatenate([p[k] for p in held]).astype(np.int64) for k in (3, 4))
            fragment = Fragment(n, np.repeat(np.arange(len(n)), per_doc), term, times, weight, documents, total)
            for k, (wanted, often) in enumerate(zip(items.terms, items.times)):
                bar = -best[k][-1][0] if len(best[k]) == top else 1
                docs, scores = fragment.best(wanted, often, top, bar)
                found = [(-s, ids[d] is None, ids[d] or 0) for d, s in zip(docs.tolist(), scores.tolist())]
                best[k] = sorted(best[k] + found)[:top]
            held.clear()

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for at in range(0, len(b), DOCUMENTS):
                part = b.slice(at, DOCUMENTS)
                per_doc = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                # Cut so that a fragment holds a bounded number of postings, or one document.
                group = np.cumsum(per_doc.astype(np.int64)) // POSTINGS
                for g in np.unique(group):
                    lo, hi = np.searchsorted(group, [g, g + 1])
                    some = part.slice(lo, hi - lo)
                    held.append((some.column(0).to_pylist(), some.column(1).to_numpy(zero_copy_only=False), per_doc[lo:hi],
                                 some.column(2).flatten().to_numpy(), some.column(3).flatten().to_numpy()))
                    if sum(len(p[0]) for p in held) >= DOCUMENTS or sum(len(p[3]) for p in held) >= POSTINGS:
                        answer()
        if held:
            answer()
        rows = [(k, items.ids[k], None if none else doc, -s) for k, found in enumerate(best) for s, none, doc in found]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], kind), pa.array(columns[3], pa.int64())],
                                             ["item", "item_id", "doc_id", "score"])

    return tops


def _shards(items: DataFrame, shard_bytes: int) -> Iterator[list[tuple]]:
    """Rows (item_id, UTF-8 text) of one shard after the other; each is about ``shard_bytes`` of text, or one item."""
    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("raw"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
    count = -(-size // shard_bytes)
    for s in range(count):
        yield [(r.item_id, bytes(r.raw)) for r in rows.where(F.pmod(F.xxhash64("item_id", "raw"), F.lit(count)) == s).collect()]


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, equal scores by doc_id.

    Whole texts count, with all their repeats.  Null texts and texts without terms hold nothing, items
    like that find nothing.  Repeated document rows are documents of their own and take ranks of their
    own; repeated items are answered as often as they are there.  A null doc_id comes after all others
    of its score; a null item_id stays null.  Without documents or items there are no rows.  Other
    columns are not read.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    out = None
    for number, rows in enumerate(_shards(items, shard_bytes)):
        shard = read_items(rows)
        if not shard.ids:
            continue
        seen = cut_lineage(counted(docs, shard.vocabulary), "counted")
        documents, total = seen.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = seen.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weights = held.select("term", F.floor(1000 * F.ln((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long").alias("w"))
        weight = np.zeros(len(shard.vocabulary), np.int64)
        for r in weights.collect():  # at most one row per term of the shard
            weight[r.term] = r.w
        local = seen.mapInArrow(_local(shard, weight, documents, total, top), f"item int, item_id long, doc_id {kind}, score long")
        # A task gives at most ``top`` rows per item; those of very many tasks are thinned out in parts first.
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        part = Window.partitionBy("item", "part").orderBy(*order)
        few = local.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(32))).withColumn("k", F.row_number().over(part)).where(F.col("k") <= top)
        best = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
        found = cut_lineage(best.select("item_id", "rank", "doc_id", "score"), "ranked")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"item_id long, rank int, doc_id {kind}, score long") if out is None else out


def sql(top: int = TOP, docs: str = "documents", items: str = "benchmark") -> str:
    """DuckDB SQL with the rows of ``ranked``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    split = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {split} AS terms FROM {docs}),
    total AS (SELECT count(*) AS cn, sum(len(terms))::BIGINT AS cl FROM doc WHERE len(terms) > 0),
    long AS (SELECT r, len(terms) AS n, unnest(terms) AS term FROM doc),
    post AS (SELECT r, n, term, count(*) AS tf FROM long GROUP BY ALL),
    weight AS (SELECT term, floor(1000 * ln((2 * cn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM post, total GROUP BY term, cn),
    item AS (SELECT row_number() OVER () AS i, item_id, {split} AS terms FROM {items}),
    want AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(terms) AS term FROM item) GROUP BY ALL),
    score AS (
      SELECT i, item_id, r, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * ({100 - SLOPE} + ({SLOPE} * n * cn) // cl))))::BIGINT AS score
      FROM want JOIN weight USING (term) JOIN post USING (term), total GROUP BY ALL),
    best AS (
      SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
      FROM score JOIN doc USING (r) WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM best WHERE rank <= {top}"""

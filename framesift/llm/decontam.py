"""Benchmark decontamination: every passage of every text queries a BM25 index of the test items.

The index holds the items of a benchmark as postings with BM25 impacts, in blocks of items with
similar thresholds; per term and block it keeps the largest impact.  A passage is evaluated like a
block-max WAND query: terms in their order of weight, cut into essential ones (an item that holds
none of them in the passage cannot reach its threshold) and the rest; the block maxima of the
essential terms bound what a block's items can score, blocks below their smallest threshold are
skipped, and only items of the other blocks are scored in full.

An item's threshold is the least score that a passage can have which holds at least ``similarity``
of the item's word shingles, so none of these is missed.  Items above it are verified: shingles of
the whole item, of its question and of its answer that the text holds.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a shingle and the least share of an item's shingles that makes a leak.
SHINGLE, SIMILARITY = 5, 0.8
K1, B = 1.2, 0.75
#: Items in a block; items and bytes of text in one broadcast index: a larger benchmark takes several passes.
BLOCK, SHARD, SHARD_BYTES = 8, 20_000, 16 << 20

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[str, str]:
    """The part up to an answer mark, the last question mark or else the last sentence's start, and the rest."""
    for cut in (re.search(r"(?im)^\s*(?:answer|a)\s*:", text), None):
        if cut and words(text[: cut.start()]) and words(text[cut.end():]):
            return text[: cut.start()], text[cut.end():]
    ends = [m.end() for m in re.finditer(r"\?\s", text)] or [m.end() for m in re.finditer(r"[.!]\s+|\n+", text)]
    for e in reversed(ends):
        if words(text[:e]) and words(text[e:]):
            return text[:e], text[e:]
    return text, ""


def shingles(w: list[str], width: int = SHINGLE) -> set[tuple[str, ...]]:
    """Distinct word shingles; a shorter sequence is one shingle as it is."""
    return {tuple(w[i: i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@dataclass
class Item:
    item_id: int
    words: list[str]
    whole: set
    question: set
    answer: set


@dataclass
class Index:
    """Postings of a bounded number of items.

    ``essential``: term to its (block, largest impact) pairs and (item, impact) pairs, for the terms
    that can decide; ``impact``: per item all terms' impacts; ``need``: what essential terms must reach.
    """

    items: list[Item]
    width: int
    similarity: float
    longest: int = 0
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    need: np.ndarray = field(default_factory=lambda: np.zeros(0))
    block_need: np.ndarray = field(default_factory=lambda: np.zeros(0))
    terms: dict[str, int] = field(default_factory=dict)
    block_start: np.ndarray = field(default_factory=lambda: np.zeros(1, int))
    block_of: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    block_max: np.ndarray = field(default_factory=lambda: np.zeros(0))
    impacts: list[dict[str, float]] = field(default_factory=list)
    short: dict[int, dict] = field(default_factory=dict)


def build(rows: list[tuple[int, str]], corpus_items: int, df: dict[str, int], average: float,
          width: int = SHINGLE, similarity: float = SIMILARITY) -> Index:
    """Index of items (item_id, text); ``df``, ``corpus_items`` and ``average`` are counts over all items."""
    items = []
    for item_id, text in rows:
        w = words(text)
        q, a = question_and_answer(text)
        items.append(Item(item_id, w, shingles(w, width), shingles(words(q), width), shingles(words(a), width)))
    idf = {t: float(np.log(1 + (corpus_items - n + 0.5) / (n + 0.5))) for t, n in df.items()}

    def impact(it: Item) -> dict[str, float]:
        norm = K1 * (1 - B + B * len(it.words) / max(average, 1e-9))
        return {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in Counter(it.words).items()}

    scored = []
    for it in items:
        imp = impact(it)
        missing = int((1 - similarity) * len(it.whole) + 1e-9)
        theta = sum(imp.values()) - sum(sorted(imp.values(), reverse=True)[:missing])
        # Non-essential terms: the most common ones, as long as together they stay under half the threshold.
        light, common = 0.0, set()
        for t in sorted(imp, key=lambda t: (-df[t], t)):
            if light + imp[t] >= 0.5 * theta:
                break
            light += imp[t]
            common.add(t)
        scored.append((theta - light - 1e-9, theta - 1e-9, it, imp, common))
    scored.sort(key=lambda s: (s[0], s[2].item_id))
    index = Index([s[2] for s in scored], width, similarity, max((len(s[2].words) for s in scored), default=0),
                  np.array([s[1] for s in scored]), np.array([s[0] for s in scored]), impacts=[s[3] for s in scored])
    if not scored:
        return index
    index.block_need = np.minimum.reduceat(index.need, np.arange(0, len(scored), BLOCK))
    best: dict[str, dict[int, float]] = defaultdict(dict)
    for k, (_, _, _, imp, common) in enumerate(scored):
        for t, x in imp.items():
            if t not in common:
                best[t][k // BLOCK] = max(best[t].get(k // BLOCK, 0.0), x)
    starts, blocks, tops = [0], [], []
    for t in sorted(best):
        index.terms[t] = len(index.terms)
        for blk, x in sorted(best[t].items()):
            blocks.append(blk)
            tops.append(x)
        starts.append(len(blocks))
    index.block_start, index.block_of, index.block_max = np.array(starts), np.array(blocks), np.array(tops)
    return index


def search(text: str | None, index: Index) -> list[tuple[int, float, float, float, float]]:
    """Leaked items of a text: (item_id, best passage score, share of the whole, of the question, of the answer).

    Passages are twice as long as the longest item and overlap by its length, so each occurrence of
    an item lies whole in one of them.  A longer text is a passage as well, for items whose parts lie further apart.
    """
    w = words(text)
    if not w or not index.items:
        return []
    ids = np.fromiter(map(index.terms.get, w, repeat(-1)), np.int32, len(w))
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return []
    step = max(index.longest, index.width)
    last = max(0, -(-len(w) // step) - 2)
    # A term at word p lies in the passages that start at (p // step - 1) and (p // step) steps.
    hi = at // step
    passage = np.concatenate([np.minimum(hi, last), np.clip(hi - 1, 0, last)])
    terms = np.concatenate([ids[at], ids[at]])
    if last:  # the whole text comes after the others
        passage, terms = np.concatenate([passage, np.full(len(at), last + 1)]), np.concatenate([terms, ids[at]])
    pair = np.unique(passage.astype(np.int64) * len(index.terms) + terms)
    passage, term = pair // len(index.terms), pair % len(index.terms)
    first, count = index.block_start[term], index.block_start[term + 1] - index.block_start[term]
    slot = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    where = np.repeat(passage, count) * len(index.block_need) + index.block_of[slot]
    keys, inverse = np.unique(where, return_inverse=True)
    bound = np.bincount(inverse, index.block_max[slot])
    keys = keys[bound >= index.block_need[keys % len(index.block_need)]]
    found: dict[int, float] = {}
    held_at, held = -1, set()
    for key in keys.tolist():
        p, blk = divmod(key, len(index.block_need))
        if p != held_at:
            held_at, held = p, set(w if last and p > last else w[p * step: (p + 2) * step])
        for k in range(blk * BLOCK, min(len(index.items), (blk + 1) * BLOCK)):
            if last and p > last and k in found:
                continue  # its best passage is known
            score = sum(x for t, x in index.impacts[k].items() if t in held)
            if score >= index.theta[k]:
                found[k] = max(found.get(k, 0.0), score)
    if not found:
        return []
    share = lambda some: sum(holds(s) for s in some) / len(some) if some else 1.0
    here, short = shingles(w, index.width), {}

    def holds(s: tuple[str, ...]) -> bool:
        """Whether the text holds a shingle; a part shorter than a shingle is looked up by its own length."""
        if len(s) == index.width:
            return s in here
        if len(s) not in short:
            short[len(s)] = {tuple(w[i: i + len(s)]) for i in range(len(w) - len(s) + 1)}
        return s in short[len(s)]

    out = []
    for k, score in sorted(found.items()):
        it = index.items[k]
        whole = share(it.whole)
        if whole >= index.similarity - 1e-12:
            out.append((it.item_id, float(score), whole, share(it.question), share(it.answer)))
    return out


HITS = "array<struct<item_id: bigint, score: double, overlap: double, question_overlap: double, answer_overlap: double>>"


def indexes(benchmark: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, shard: int = SHARD, shard_bytes: int = SHARD_BYTES) -> list[Index]:
    """Indexes of about ``shard`` items and ``shard_bytes`` of text each; term statistics come from all items.

    Items without words and null ids are left out.  Repeated rows of an item are one.
    """

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words)

    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    each = rows.select(split("text").alias("w"), F.octet_length("text").alias("bytes")).where(F.size("w") > 0)
    count, average, size = each.agg(F.count(F.lit(1)), F.avg(F.size("w")), F.sum("bytes")).first()
    if not count:
        return []
    shards = max(-(-count // shard), -(-size // shard_bytes))
    totals = each.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    out = []
    for s in range(shards):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == s)
        got = sorted((r.item_id, r.text) for r in part.collect() if words(r.text))
        if got:
            mine = part.select(F.explode(split("text")).alias("t")).distinct()
            df = {r.t: r.n for r in totals.join(mine, "t").collect()}
            out.append(build(got, count, df, average, width, similarity))
    return out


def leaks(text: Column, index: Index) -> Column:
    """Verified leaks of a text as an array; only the text goes through Python."""

    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("item_id", "score", "overlap", "question_overlap", "answer_overlap"), hit)) for hit in search(t, index)] for t in texts])

    return find(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row per (document row, leaked item): doc_id, item_id, score, overlap, question_overlap, answer_overlap.

    ``overlap`` is the share of the item's distinct shingles that the whole text holds; at least
    ``similarity`` makes a leak.  A part without words (an item that is all question) has overlap 1.
    Null and empty texts leak nothing; a null doc_id stays null; repeated document rows are reported
    as often as they are there.  Empty tables give no rows; other columns are not read.
    """
    found = None
    for index in indexes(benchmark, width, similarity):
        hits = docs.select("doc_id", F.explode(leaks(F.col("text"), index)).alias("h")).select("doc_id", "h.*")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        kind = dict(docs.dtypes)["doc_id"]
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, score double, overlap double, question_overlap double, answer_overlap double")
    return found


def clean(docs: DataFrame, benchmark: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs`` that leak no item, with all their columns."""
    for index in indexes(benchmark, width, similarity):
        docs = docs.where(F.size(leaks(F.col("text"), index)) == 0)
    return docs

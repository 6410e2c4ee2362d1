"""Near-duplicate groups by the sets of word shingles themselves.

Two texts are linked where their sets of distinct shingles have a Jaccard similarity of at least
``SIMILARITY``; linked texts form a component.  Texts with equal sets are folded first.

Pairs to compare come from SimHash first (``simhash.linked``): the fingerprints of the same shingles,
compared on bit planes, and every two sets in one component of fingerprints share a bucket.  At 0.8
two fingerprints differ in ten bits or so, far more than buckets of agreeing blocks can look for, so
min-wise hashes give the pairs beyond the radius: a set has ``BANDS`` keys, each made of ``ROWS``
minima, and two sets at similarity s share no key with a chance of (1 - s ** ROWS) ** BANDS, 3.3e-8
at 0.8 and less above.  Every pair is then decided on the whole sets, so what is dropped never rests
on a fingerprint or a sketch.

Each set first meets one other, the leader that it shares most of its keys with, which folds a crowded
group of copies by one row per copy.  Buckets whose sets are then still in different components are
compared in tiles: a task gets two tiles of a bucket with their whole sets, multiplies their incidence
matrices, and gives out a forest of the links it finds between components, never the pairs it
compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import join_hot, smallest_reachable
from framesift.llm.simhash import RADIUS, SEED, first_of_each, linked, majority, shingle_hashes
from framesift.session import cut_lineage

SHINGLE, SIMILARITY = 5, (4, 5)
BANDS, ROWS = 24, 3
#: Keys of a set, about: those of its bands and the component of its fingerprint.
KEYS = BANDS + 1
#: Shingles whose minima are taken at once; sets and shingles of a tile, about.
BLOCK, TILE, SHINGLES = 2048, 512, 1 << 18
#: How many products of a dense matrix cost as much as one by lists, and columns multiplied at once.
DENSE, COLUMNS = 16, 2048

_RNG = np.random.default_rng(SEED)
_MASKS = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODDS = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_set(raw: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of UTF-8 bytes; fewer words are one shingle, none are none."""
    return _distinct(list(shingle_hashes(raw, width)))


def _distinct(chunks: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(chunks)) if chunks else np.zeros(0, np.uint64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """Unsigned keys of a set, one per band; an empty set has none."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(low, ((hashes[i: i + BLOCK, None] ^ _MASKS) * _ODDS).min(axis=0), out=low)
    return [xxhash.xxh64_intdigest(low[b * ROWS: (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def _lists(values: list) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([np.asarray(v, np.uint64) for v in values]) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, fp, whole, size, bands) of every row.

    ``fp`` is the fingerprint of the shingles, repeats included, ``whole`` names their set and ``size`` is its number.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, whole, size, bands = [], [], [], []
            for x in b.column(2):
                chunks = list(shingle_hashes(x.as_py(), width))
                h = _distinct(chunks)
                fps.append(majority(chunks))
                whole.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                size.append(len(h))
                bands.append(band_keys(h))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, whole)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *signed, pa.array(size, pa.int64()), _lists(bands)],
                                             ["doc_id", "mark", "fp", "whole", "size", "bands"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return narrow.mapInArrow(rows, "doc_id long, mark long, fp long, whole long, size long, bands array<long>")


def _sets(docs: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """(whole, hashes) of the sets in ``named`` (whole, pick), made again from one text of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingle_set(x.as_py(), width) for x in b.column(1)])], ["whole", "hashes"])

    wanted = named.select("whole", F.col("pick.doc_id").alias("__id"), F.col("pick.mark").alias("__mark"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    met = texts.join(wanted, (F.col("mark") == F.col("__mark")) & F.col("id").eqNullSafe(F.col("__id"))).select("whole", "text")
    # Repeated rows give a set more than once.
    return met.mapInArrow(rows, "whole long, hashes array<long>").dropDuplicates(["whole"])


def agrees(shared: np.ndarray, one: np.ndarray, two: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether sets of sizes ``one`` and ``two`` with ``shared`` members in common agree to p / q."""
    p, q = similarity
    return shared * (p + q) >= (one + two) * p


def _folded(pairs: DataFrame, hashes: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose whole sets agree; each u is in one pair, so a set moves as often as it has pairs."""
    one = hashes.select(F.col("whole").alias("u"), F.col("hashes").alias("hu"))
    two = hashes.select(F.col("whole").alias("v"), F.col("hashes").alias("hv"))
    both = pairs.join(one, "u").join(two, "v")
    p, q = similarity
    shared = F.size(F.array_intersect("hu", "hv")).cast("long")
    return both.where(shared * (p + q) >= (F.size("hu") + F.size("hv")) * p).select("u", "v")


def shared_counts(member: np.ndarray, shingle: np.ndarray, n: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of the matrix of shared shingles of ``n`` sets: (first row, counts of its rows with all sets).

    Either as products of dense blocks or, where few sets share a shingle, by the sets of each shingle.
    """
    df = np.bincount(shingle, minlength=width)
    rows = 256
    if float(df @ df) * DENSE < float(n) * n * width:
        order = np.argsort(shingle, kind="stable")
        start = np.concatenate([[0], np.cumsum(df)])
        sets, first = member[order], np.searchsorted(member, np.arange(n + 1))
        for a in range(0, n, rows):
            z = min(n, a + rows)
            out = np.zeros((z - a, n), np.int64)
            for i in range(a, z):
                mine = shingle[first[i]: first[i + 1]]
                met = np.concatenate([sets[start[x]: start[x + 1]] for x in mine.tolist()]) if len(mine) else np.zeros(0, np.int64)
                out[i - a] = np.bincount(met, minlength=n)
            yield a, out
        return
    total = np.zeros((n, n), np.float32)
    order = np.argsort(shingle, kind="stable")
    sets, columns = member[order], shingle[order]
    for c in range(0, width, COLUMNS):
        s, e = np.searchsorted(columns, [c, c + COLUMNS])
        block = np.zeros((n, min(COLUMNS, width - c)), np.float32)
        block[sets[s:e], columns[s:e] - c] = 1
        total += block @ block.T
    for a in range(0, n, rows):
        yield a, total[a: a + rows].astype(np.int64)


def forest_of(root: np.ndarray, side: np.ndarray, size: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Links (by position) between components of the sets of one unit, at most one fewer than there are components.

    ``side`` names each set's tile; only sets of different tiles are compared where there are two.
    """
    n = len(sets)
    names, comp = np.unique(root, return_inverse=True)
    if len(names) < 2:
        return [], []
    flat = np.concatenate(sets)
    member = np.repeat(np.arange(n), [len(x) for x in sets])
    _, code, often = np.unique(flat, return_inverse=True, return_counts=True)
    keep = often[code] > 1  # what only one set holds is shared by none
    number = np.cumsum(often > 1) - 1
    label = list(range(len(names)))

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    two = side.min() != side.max()
    left, right = [], []
    for a, shared in shared_counts(member[keep], number[code[keep]], n, int((often > 1).sum())):
        mine = np.arange(a, a + len(shared))
        close = agrees(shared, size[mine][:, None], size[None, :], similarity) & (comp[mine][:, None] != comp[None, :])
        if two:
            close &= side[mine][:, None] != side[None, :]
        i, j = np.nonzero(close)
        # Of the links between two components the first is enough.
        pair = comp[mine[i]] * len(names) + comp[j]
        _, at = np.unique(pair, return_index=True)
        for x, y in zip(mine[i[at]].tolist(), j[at].tolist()):
            u, v = find(int(comp[x])), find(int(comp[y]))
            if u != v:
                label[max(u, v)] = min(u, v)
                left.append(x)
                right.append(y)
    return left, right


def _compared(similarity: tuple[int, int]):
    """Function that goes through units of one or two tiles, rows sorted by key, a and b, and gives links (u, v)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def links() -> pa.RecordBatch:
            root, side = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
            sets = [r[3] for r in rows]
            i, j = forest_of(root, side, np.array([len(x) for x in sets], np.int64), sets, similarity)
            whole = np.array([r[0] for r in rows], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(whole[i] if i else whole[:0]), pa.array(whole[j] if j else whole[:0])], ["u", "v"])

        for b in batches:
            key, a, z, tile, whole, root = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            hashes = b.column(6)
            start, values = hashes.offsets.to_numpy(), hashes.values.to_numpy()
            for i in range(len(b)):
                now = (key[i], a[i], z[i])
                if now != unit:
                    if rows:
                        yield links()
                    unit, rows = now, []
                rows.append((whole[i], root[i], tile[i], values[start[i]: start[i + 1]].copy()))
        if rows:
            yield links()

    return work


def _apart(placed: DataFrame, hashes: DataFrame, similarity: tuple[int, int], count: int) -> DataFrame:
    """Links (u, v) between components of sets that share a bucket; ``placed`` has (key, whole, size, root)."""
    split = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("met"), F.sum("size").alias("all"))
    tiles = F.greatest(F.ceil(F.col("met") / TILE), F.ceil(F.col("all") / SHINGLES)).cast("int")
    split = split.where("a != b").select("key", "met", tiles.alias("tiles"))
    met = join_hot(placed, split, "key", "met", count * KEYS).withColumn("tile", F.pmod(F.xxhash64("whole"), F.col("tiles")).cast("int"))
    # Every pair of tiles of a bucket is a unit; most buckets have one tile and so one unit.
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    units = met.select("key", "whole", "root", "tile", other).select(
        "key", F.least("tile", "other").cast("int").alias("a"), F.greatest("tile", "other").cast("int").alias("b"), "tile", "whole", "root")
    full = units.join(hashes, "whole").select("key", "a", "b", "tile", "whole", "root", "hashes")
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.repartition(parts, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInArrow(_compared(similarity), "u long, v long").distinct()


def _alike(rows: DataFrame, radius: int) -> DataFrame:
    """(whole, size, key) of every set: ``key`` names a component of fingerprints within the radius, of each text that has the set."""
    found, total = linked(rows, radius)
    named = cut_lineage(found.select("fp", "n", "root"), "alike")
    of_sets = rows.groupBy("whole", "fp").agg(F.first("size").alias("size"))
    return join_hot(of_sets, named, "fp", "n", total).select("whole", "size", F.col("root").alias("key")).distinct()


def one_of_each(docs: DataFrame, width: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with its smallest doc_id (a null id comes last).

    ``similarity`` is a fraction p / q, ``radius`` that of the fingerprints.  All columns come back unchanged; of repeated rows one stays.
    Null texts and texts without words have the same, empty, set.
    """
    p, q = similarity
    rows = cut_lineage(sketches(docs, width), "sketches")
    pick = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    sets = cut_lineage(rows.groupBy("whole").agg(F.min(pick).alias("pick"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands")), "distinct")
    total, count = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    alike = cut_lineage(_alike(rows, radius), "keys")
    keyed = alike.unionByName(sets.select("whole", "size", F.explode("bands").alias("key")))
    leaders = keyed.groupBy("key").agg(F.min(F.struct("whole", "size")).alias("lead"), F.count(F.lit(1)).alias("met")).where("met > 1")
    # Members of shared buckets only; most sets share none.
    members = cut_lineage(join_hot(keyed, leaders, "key", "met", count * KEYS).select("key", "whole", "size", "lead"), "members")
    ends = members.select("whole").distinct()
    hashes = cut_lineage(_sets(docs, sets.select("whole", "pick").join(ends, "whole"), width), "sets")
    close = F.least("size", "lead.size") * q >= F.greatest("size", "lead.size") * p
    stars = members.where((F.col("whole") != F.col("lead.whole")) & close).groupBy("whole", F.col("lead.whole").alias("v")).agg(F.count(F.lit(1)).alias("keys"))
    most = stars.groupBy(F.col("whole").alias("u")).agg(F.max_by("v", F.struct("keys", F.bitwise_not("v"))).alias("v"))
    links = cut_lineage(_folded(most, hashes, similarity), "agreeing")
    roots = cut_lineage(smallest_reachable(links), "roots")
    placed = cut_lineage(members.join(roots.withColumnRenamed("node", "whole"), "whole", "left").select("key", "whole", "size", F.coalesce("root", "whole").alias("root")), "placed")
    more = cut_lineage(_apart(placed, hashes, similarity, count), "apart")
    if not more.isEmpty():
        roots = smallest_reachable(links.unionByName(more))
    named = cut_lineage(sets.join(roots.withColumnRenamed("node", "whole"), "whole", "left").select("whole", "n", F.coalesce("root", "whole").alias("root")), "components")
    return first_of_each(docs, join_hot(rows.select("doc_id", "mark", "whole"), named, "whole", "n", total))

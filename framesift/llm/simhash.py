"""SimHash near-duplicate groups, compared on vertical bit planes.

A fingerprint is 64 majority votes over the XXH64 hashes of a text's word shingles.  Fingerprints
that differ in at most ``radius`` bits are linked, and linked fingerprints form a component.

The comparison works on distinct fingerprints.  Their 64 bits are cut into blocks; two fingerprints
within the radius agree on all but ``radius`` of the blocks, so they share a bucket for at least one
choice of agreeing blocks.  Inside a bucket the fingerprints are stored as bit planes (one machine
word holds one bit of 64 fingerprints), and the distances of many pairs are counted at once with
carry-save adders; a block of lanes is abandoned once each of them has passed the radius.  Crowded
buckets are cut into tiles, and every pair of tiles is a unit of work of bounded size.  A unit gives
out a spanning forest of the links it finds, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import join_hot, smallest_reachable
from framesift.session import cut_lineage

RADIUS, SHINGLE, SEED, BITS = 4, 4, 42, 64
#: Fingerprints in a tile of a crowded bucket; a unit of work compares at most two tiles.
TILE = 1024
#: Shingles counted at once; bounds the memory that a very long text takes.
CHUNK = 1 << 16


def shingle_hashes(raw: bytes | None, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 hashes of the word shingles of UTF-8 bytes, repeats included, CHUNK at a time; fewer words are one shingle, none are none."""
    words = raw.lower().split() if raw else []
    if not words:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    starts, ends = (starts[: len(words) - width + 1], ends[width - 1:]) if len(words) >= width else (starts[:1], ends[-1:])
    for i in range(0, len(starts), CHUNK):
        s, e = starts[i: i + CHUNK].tolist(), ends[i: i + CHUNK].tolist()
        yield np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, s, e)), repeat(SEED)), np.uint64, len(s))


def majority(chunks: Iterable[np.ndarray]) -> int:
    """Unsigned fingerprint of hashes: a bit is set where it is in over half of them; zero for none."""
    votes, n = np.zeros(BITS, np.int64), 0
    for hashes in chunks:
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(hashes)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(raw: bytes | None, width: int = SHINGLE) -> int:
    """Unsigned fingerprint of UTF-8 bytes; zero for a null text or one without words."""
    return majority(shingle_hashes(raw, width))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE) -> DataFrame:
    """(doc_id, mark, fp): the signed fingerprint of every row, and a hash that tells texts of one id apart."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in b.column(2)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "mark", "fp"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    return narrow.mapInArrow(rows, "doc_id long, mark long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of uint64 fingerprints: (64, words), bit ``i`` of the lanes in row ``i``; spare lanes are zero."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((-(-len(fps) // 64) * 64, BITS), np.uint8)
    padded[: len(fps)] = bits
    return np.packbits(padded, axis=0, bitorder="little").T.copy().view(np.uint64)


def beyond(differing: Iterator[np.ndarray], radius: int, step: int = 8) -> np.ndarray:
    """Lanes with more than ``radius`` set bits over the given planes, as a plane.

    Two planes at a time go through a full adder into the ones; carries ripple through the higher
    counter bits, and a carry out of the last one, or a count past the radius, sticks.
    """
    width = max(1, radius.bit_length())
    counters: list[np.ndarray] = []
    over = None

    def carry_into(level: int, c: np.ndarray) -> None:
        nonlocal over
        for k in range(level, width):
            counters[k], c = counters[k] ^ c, counters[k] & c
        over |= c

    def past() -> np.ndarray:
        """Lanes whose counter is above the radius: compared bit by bit from the top."""
        above, same = over.copy(), ~over
        for k in range(width - 1, -1, -1):
            if radius >> k & 1:
                same &= counters[k]
            else:
                above |= same & counters[k]
                same &= ~counters[k]
        return above

    held = None
    for n, d in enumerate(differing, 1):
        if over is None:
            counters, over = [np.zeros_like(d) for _ in range(width)], np.zeros_like(d)
        if held is None:
            held = d
        else:
            ones = counters[0]
            half = ones ^ held
            counters[0] = half ^ d
            carry_into(1, (ones & held) | (half & d))
            held = None
        if n % step == 0:
            dead = past()
            if (dead == np.uint64(0xFFFFFFFFFFFFFFFF)).all():
                return dead
    if held is not None:
        carry_into(0, held)
    return past()


def near_lanes(pivots: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (pivot, lane) within the radius, by bit-sliced counting of 64 pivots at a time."""
    sliced, found = planes(lanes), []
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(pivots), 64):
        some = pivots[at: at + 64]
        flips = [((some >> np.uint64(i)) & np.uint64(1)) * ones for i in range(BITS)]
        dead = beyond((sliced[i][None, :] ^ flips[i][:, None] for i in range(BITS)), radius)
        alive = np.unpackbits((~dead).view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")[:, : len(lanes)]
        p, q = np.nonzero(alive)
        found.append((p + at, q))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2


def near_pairs_of(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) are within the radius: one lane per pair."""
    if not len(a):
        return np.zeros(0, bool)
    dead = beyond(iter(planes(a ^ b)), radius)
    return np.unpackbits((~dead).view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (node, smallest node reached) of the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows sorted by unit, as arrays that never cut a unit in two.

    A unit holds about two tiles at most, so what is carried from batch to batch is bounded.
    """
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield tuple(c[:cut] for c in cols)
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield tuple(rest)


def _links(radius: int, small: int = 16):
    """Spanning links of each unit; rows are (choice, key, a, b, tile, fp), sorted by the first four."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for choice, key, a, b, tile, fp in _units(batches):
            fp = fp.astype(np.int64)
            bits = fp.view(np.uint64)
            new = np.ones(len(fp), bool)
            new[1:] = (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fp)))
            unit = np.repeat(np.arange(len(starts)), sizes)
            left, right = [], []
            few = np.repeat((sizes <= small) & (a[starts] == b[starts]), sizes)
            for shift in range(1, min(small, int(sizes.max(initial=0)))):
                i = np.flatnonzero(few[:-shift] & (unit[shift:] == unit[:-shift]))
                i = i[near_pairs_of(bits[i], bits[i + shift], radius)]
                left.append(fp[i])
                right.append(fp[i + shift])
            for k in np.flatnonzero(~few[starts]):
                at = slice(starts[k], starts[k] + sizes[k])
                mine, tiles = bits[at], tile[at]
                one = mine[tiles == a[starts[k]]] if a[starts[k]] != b[starts[k]] else mine
                two = mine[tiles == b[starts[k]]] if a[starts[k]] != b[starts[k]] else mine
                if len(one) and len(two):
                    p, q = near_lanes(one, two, radius)
                    x, y = forest(one[p].view(np.int64), two[q].view(np.int64))
                    left.append(x)
                    right.append(y)
            if left:
                u, v = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return work


def blocks_for(count: int, radius: int = RADIUS) -> int:
    """Blocks to cut the bits into: agreeing blocks give about log2(count) bits, so that buckets stay small."""
    c = radius + 2
    while c < 2 * radius + 4 and BITS * (c - radius) / c < log2(max(2, count)) + 2:
        c += 1
    return c


def near_links(distinct: DataFrame, count: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within the radius, exactly."""
    c = blocks_for(count, radius)
    edges = [round(BITS * i / c) for i in range(c + 1)]
    block = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(c)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = [signed(sum(block[i] for i in some)) for some in combinations(range(c), c - radius)]
    assert len(masks) == comb(c, radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("choice", "key"))
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    met = keyed.join(sizes, ["choice", "key"]).withColumn("tile", F.pmod(F.xxhash64("fp"), tiles).cast("int"))
    # Every pair of tiles of a bucket is a unit; most buckets have one tile and so one unit.
    other = F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
    units = met.select("choice", "key", "tile", "fp", other).select(
        "choice", "key", F.least("tile", "other").cast("int").alias("a"), F.greatest("tile", "other").cast("int").alias("b"), "tile", "fp")
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_units = units.repartition(parts, "choice", "key", "a", "b").sortWithinPartitions("choice", "key", "a", "b")
    return sorted_units.mapInArrow(_links(radius), "u long, v long").distinct()


def linked(rows: DataFrame, radius: int = RADIUS, tile: int = TILE) -> tuple[DataFrame, int]:
    """(fp, first, n, root) of the distinct fingerprints of ``rows`` (doc_id, fp), and the number of rows.

    ``root`` names the component, ``first`` is the smallest doc_id with the fingerprint and ``n`` its number of rows.
    """
    per_fp = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    total, count = per_fp.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    roots = smallest_reachable(near_links(per_fp.select("fp"), count, radius, tile))
    return per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), total


def _grouped(docs: DataFrame, radius: int, width: int, tile: int) -> DataFrame:
    """(doc_id, mark, fp, root, component_id) of every row; ``root`` names the component."""
    rows = cut_lineage(fingerprints(docs, width=width), "fingerprints")
    found, total = linked(rows, radius, tile)
    lowest = found.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut_lineage(found.join(lowest, "root").select("fp", "n", "root", "component_id"), "components")
    return join_hot(rows, named, "fp", "n", total)


def components(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of fingerprints.  A null text has
    fingerprint zero, as has one without words; zero is linked like any other.  Repeated rows come
    back as often as they are there.  A null doc_id is kept; it is never the smallest unless a
    component has no other, and then component_id is null.  Empty input gives no rows.  Other
    columns of ``docs`` are not read.
    """
    return _grouped(docs, radius, width, tile).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with its smallest doc_id (a null id comes last).

    All columns of ``docs`` come back unchanged.  Of repeated rows one stays.
    """
    return first_of_each(docs, _grouped(docs, radius, width, tile))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``root`` of ``found`` (doc_id, mark, root): that with its smallest doc_id."""
    same = found.groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"))
    first = same.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "rows")).alias("pick"))
    picks = cut_lineage(first.select(F.col("pick.doc_id").alias("__id"), F.col("pick.mark").alias("__mark"), F.col("pick.rows").alias("__rows")), "picks")
    marked = docs.withColumn("__own", F.xxhash64("text"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark"))
    kept = marked.join(picks.where("__rows = 1"), on, "left_semi")
    repeated = picks.where("__rows > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(marked.join(repeated, on, "left_semi").dropDuplicates(["doc_id", "__own"]))
    return kept.drop("__own")

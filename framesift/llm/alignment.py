"""Alignment of two tokenizers over the same bytes by sparse products of incidence matrices.

A text's tokens by each tokenizer cover the same bytes.  A token-byte incidence matrix A has a row per
token and a one in the columns of its bytes; the product A·Bᵀ then holds, for every pair of tokens
that overlap, how many bytes they share.  Byte offsets at which tokens of both end cut the text into
groups; the product of the two token-group matrices links all tokens that share a group.  Matrices are
kept in compressed rows and multiplied by Gustavson's row products, some rows at a time.

Both tokenizers treat what stands between single spaces on its own, so the line of bytes that is
multiplied is made of the distinct segments of some texts, and what a segment gives is remembered.

How strong a link between two vocabularies is comes from the corpus: the number of documents that
hold the pair linked, and whether that is the most of any pair with that first id.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.session import cut_lineage

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Products formed at once, bytes of text at a time, segments and their longest length that a task remembers.
AT_ONCE, AT_A_TIME, REMEMBERED, LONGEST = 1 << 20, 1 << 20, 150_000, 64
#: Segments encoded at once, bits of one count among those that are added up as one number, and text bytes of a batch that leaves a task.
SEGMENTS, FIELD, LEAVING = 10_000, 48, 2 << 20
#: Pairs in at least one of so many of all (document, pair) rows are broadcast: so there are at most that many.
HOT = 1 << 18


@dataclass
class Csr:
    """Sparse matrix in compressed rows: row r has ``columns[start[r]:start[r + 1]]`` with ``values``."""

    start: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.start) - 1

    def transposed(self) -> Csr:
        """Rows and columns exchanged, by counting the entries of each column."""
        count = np.bincount(self.columns, minlength=self.width)
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(self.rows), np.diff(self.start))
        return Csr(np.concatenate([[0], np.cumsum(count)]), row[order], self.values[order], self.rows)

    def products(self, other: Csr) -> np.ndarray:
        """Number of single products behind each row of ``self`` times ``other``."""
        each = np.diff(other.start)[self.columns]
        return np.diff(np.concatenate([[0], np.cumsum(each)])[self.start])

    def times(self, other: Csr, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, columns, values) of the product, in order, a block of whole rows at a time.

        Gustavson: a row of the product is the sum of the rows of ``other`` that the row's entries name.
        A block holds about ``at_once`` single products, or one row.
        """
        before = np.concatenate([[0], np.cumsum(self.products(other))])
        a = 0
        while a < self.rows:
            z = max(a + 1, int(np.searchsorted(before, before[a] + at_once, "right")) - 1)
            s, e = self.start[a], self.start[z]
            named = self.columns[s:e]
            size = other.start[named + 1] - other.start[named]
            total = int(size.sum())
            # Positions in ``other`` of each named row's entries, one after another.
            slot = np.arange(total) + np.repeat(other.start[named] - np.cumsum(size) + size, size)
            row = np.repeat(np.repeat(np.arange(a, z), np.diff(self.start[a:z + 1])), size)
            key = row * other.width + other.columns[slot]
            value = np.repeat(self.values[s:e], size) * other.values[slot]
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
            if total:
                yield key[first] // other.width, key[first] % other.width, np.add.reduceat(value, first)
            a = z


def byte_incidence(sizes: np.ndarray) -> Csr:
    """Token-byte matrix of tokens of these sizes, end to end."""
    total = int(sizes.sum())
    return Csr(np.concatenate([[0], np.cumsum(sizes)]), np.arange(total), np.ones(total, np.int64), total)


def groups_of(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group number of every token of both, and how many groups there are."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    # Both rise, and both end with the text.
    cut = ends_a[ends_b[np.searchsorted(ends_b, ends_a)] == ends_a]
    return np.searchsorted(cut, ends_a), np.searchsorted(cut, ends_b), len(cut)


def group_incidence(group: np.ndarray, groups: int) -> Csr:
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), groups)


class Pair:
    """The two tokenizers, with the bytes of each of their entries."""

    def __init__(self, first: str = BYTES, second: str = PIECES):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(public_tokenizers.path(first))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second))
        # Byte-level entries write each byte as a printable character: itself where it is one, else the next from U+0100.
        shown = sorted(map(ord, pre_tokenizers.ByteLevel.alphabet()))
        themselves = [c for c in shown if c < 256]
        others = [b for b in range(256) if b not in set(themselves)]
        byte_of = {c: c for c in themselves} | {256 + i: b for i, b in enumerate(others)}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.width_a, self.width_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.bytes_a = [b""] * self.width_a
        for entry, i in vocabulary.items():
            plain = all(ord(c) in byte_of for c in entry)
            self.bytes_a[i] = bytes(byte_of[ord(c)] for c in entry) if plain else entry.encode()
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:-1], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.width_b)]
        self.size_a, self.size_b = (np.array(list(map(len, table)), np.int64) for table in (self.bytes_a, self.bytes_b))
        self.starts_a, self.starts_b = (np.array([x[:1] == b" " for x in table]) for table in (self.bytes_a, self.bytes_b))
        # Ids as text, with the mark that follows them inside a group and at the end of their side of it.
        self.shown = [np.array([f"{i}{mark}" for i in range(width)], object) for width, marks in ((self.width_a, ",|"), (self.width_b, ",;")) for mark in marks]
        self.seen: dict[str, tuple | None] = {}

    def tokens(self, segments: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids by both of segments that begin with a space; None where their bytes are not the segment's."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        ids_b = self.b.encode([s[1:] for s in segments], num_threads=1)
        out = []
        for s, a, b in zip(segments, ids_a, ids_b):
            raw = s.encode()
            same = b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw
            out.append((a, b) if same else None)
        return out

    def joined(self, segments: list[str]) -> tuple[np.ndarray, ...] | None:
        """(ids, ids, ends, ends) of segments encoded as one text, where only segments begin with a space; None if bytes differ."""
        text = "".join(segments)
        raw = text.encode()
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text[1:]), np.int64)
        if b"".join([self.bytes_a[i] for i in a.tolist()]) != raw or b"".join([self.bytes_b[i] for i in b.tolist()]) != raw:
            return None
        want = np.cumsum([0, *[len(s.encode()) for s in segments]])
        ends = []
        for ids, sizes, starts in ((a, self.size_a, self.starts_a), (b, self.size_b, self.starts_b)):
            at = np.concatenate([np.flatnonzero(starts[ids]), [len(ids)]])
            if not np.array_equal(np.concatenate([[0], np.cumsum(sizes[ids])])[at], want):
                return None
            ends.append(at[1:])
        return a, b, *ends

    def align(self, segments: list[str]) -> dict[str, tuple | None]:
        """Per segment (counts, groups as text, pair codes as bytes), or None where the bytes differ; see ``unpacked``."""
        out: dict[str, tuple | None] = {}
        single, plain = [], []
        for s in segments:
            (plain if len(s) > 1 and " " not in s[1:] and "▁" not in s and not _blank(s[1]) and not _blank(s[-1]) else single).append(s)
        got = self.joined(plain) if plain else None
        if got:
            out.update(self.entries(plain, *got))
        else:
            single = segments
        found = self.tokens(single)
        out.update((s, None) for s, t in zip(single, found) if not t)
        good = [(s, t) for s, t in zip(single, found) if t]
        if good:
            a, b = (np.array([i for _, t in good for i in t[k]], np.int64) for k in (0, 1))
            out.update(self.entries([s for s, _ in good], a, b, *[np.cumsum([len(t[k]) for _, t in good]) for k in (0, 1)]))
        return out

    def entries(self, segments: list[str], a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> Iterator[tuple[str, tuple]]:
        """What ``align`` gives, from the ids of segments end to end and where each segment's tokens end."""
        size_a, size_b = self.size_a[a], self.size_b[b]
        group_a, group_b, count = groups_of(size_a, size_b)
        rows, codes = [], []
        for row, column, _ in byte_incidence(size_a).times(byte_incidence(size_b).transposed()):
            rows.append(row)
            codes.append(a[row] * self.width_b + b[column])
        row = np.concatenate(rows)
        code = np.concatenate(codes).astype(np.int32 if self.width_a * self.width_b < 1 << 31 else np.int64)
        shared = np.concatenate([[0], np.cumsum(group_incidence(group_a, count).products(group_incidence(group_b, count).transposed()))])
        # Each group's first ids, then its second ones, every id with the mark that follows it.
        text = np.empty(len(a) + len(b), object)
        before_b, upto_a = np.searchsorted(group_b, group_a), np.searchsorted(group_a, group_b, "right")
        for ids, group, place, inner, last in ((a, group_a, np.arange(len(a)) + before_b, *self.shown[:2]), (b, group_b, np.arange(len(b)) + upto_a, *self.shown[2:])):
            final = np.append(group[1:] != group[:-1], True)
            text[place[~final]] = inner[ids[~final]]
            text[place[final]] = last[ids[final]]
        parts, raw, width = text.tolist(), code.tobytes(), code.itemsize
        # Segments end where groups end, so each has whole groups and links.
        end_group = group_a[end_a - 1] + 1
        end_link = np.searchsorted(row, end_a)
        at_a = at_b = at_group = at_link = at_shared = 0
        for s, za, zb, zg, zl, zs in zip(segments, end_a.tolist(), end_b.tolist(), end_group.tolist(), end_link.tolist(), shared[end_a].tolist()):
            counts = za - at_a | (zb - at_b) << FIELD | (zg - at_group) << 2 * FIELD | (zl - at_link) << 3 * FIELD | (zs - at_shared) << 4 * FIELD
            yield s, (counts, "".join(parts[at_a + at_b: za + zb]), raw[width * at_link: width * zl])
            at_a, at_b, at_group, at_link, at_shared = za, zb, zg, zl, zs

    def texts(self, texts: list[str | None]) -> Iterator[tuple | None]:
        """(counts, groups as text, pair codes as bytes) of each whole text; None for one without tokens."""
        i = 0
        while i < len(texts):
            size, cut = 0, []
            while i < len(texts) and size < AT_A_TIME:
                cut.append(segments_of(texts[i]) if texts[i] else [])
                size += len(texts[i] or "")
                i += 1
            here = set().union(*cut)
            new = list(here.difference(self.seen))
            for k in range(0, len(new), SEGMENTS):
                self.seen.update(self.align(new[k: k + SEGMENTS]))
            get = self.seen.__getitem__
            for segments in cut:
                held = list(map(get, segments))
                if not held or None in held:
                    yield None
                else:
                    counts, shown, codes = zip(*held)
                    yield sum(counts), "".join(shown)[:-1], b"".join(codes)
            if len(self.seen) > REMEMBERED:  # what was just met is likely to be met again
                self.seen = {s: self.seen[s] for s in here if len(s) <= LONGEST}


def unpacked(counts: int) -> list[int]:
    """Tokens of both, groups, links and shared-group links of one number that holds them side by side."""
    return [counts >> k * FIELD & (1 << FIELD) - 1 for k in range(4)] + [counts >> 4 * FIELD]


#: A space beside other white space, or white space at an end: a text with single spaces only is cut at each.
_UNEVEN = re.compile(r"\A[\s\u180e]|[\s\u180e]\Z| [\s\u180e]|[\s\u180e] ")


def _blank(c: str) -> bool:
    return c.isspace() or c == "᠎"


def segments_of(text: str) -> list[str]:
    """A space and the text, cut before every single space between two characters that are no white space."""
    words = text.split(" ")
    if not _UNEVEN.search(text):
        return [" " + w for w in words]
    out, before = [" " + words[0]], words[0]
    for w in words[1:]:
        if before and w and not _blank(before[-1]) and not _blank(w[0]):
            out.append(" " + w)
        else:
            out[-1] += " " + w
        before = w
    return out


def _read(raw: bytes | None) -> str | None:
    """Text of UTF-8 bytes; bytes that are none have no tokens, like a null."""
    try:
        return raw.decode("utf-8") if raw else None
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=2)
def _pair(first: str, second: str) -> Pair:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Pair(first, second)


def aligned(docs: DataFrame, first: str = BYTES, second: str = PIECES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_shared, groups, pairs, times) of every document row.

    ``groups`` lists each group's ids as ``a1,a2|b1`` between semicolons; ``pairs`` are the distinct
    pairs of linked ids, as first id times the second vocabulary's size plus second id, and ``times``
    how often each is linked.  ``n_shared`` counts the pairs of tokens that share a group.
    """
    pair = _pair(first, second)
    code = "int" if pair.width_a * pair.width_b < 1 << 31 else "long"
    kind, number = dict(docs.dtypes)["doc_id"], np.int32 if code == "int" else np.int64
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "pairs", "times"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _pair(first, second)
        for whole in batches:
            sizes = np.cumsum([len(t or b"") for t in whole.column(1).to_pylist()]) // LEAVING
            for lo, hi in [(int(np.searchsorted(sizes, g)), int(np.searchsorted(sizes, g, "right"))) for g in np.unique(sizes)]:
                b = whole.slice(lo, hi - lo)
                counts, shown, codes, times = [], [], [], []
                for x in tokenizers.texts([_read(t) for t in b.column(1).to_pylist()]):
                    counts.append(unpacked(x[0]) if x else [0] * 5)
                    shown.append(x[1] if x else "")
                    c, n = np.unique(np.frombuffer(x[2], number), return_counts=True) if x else (np.zeros(0, number), np.zeros(0, np.int64))
                    codes.append(c)
                    times.append(n)
                offsets = pa.array(np.cumsum([0, *map(len, codes)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, k), *x]).astype(k))) for x, k in ((codes, number), (times, np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(5)], pa.array(shown, pa.string()), *lists], names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        rows, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups string, pairs array<{code}>, times array<int>")


def pair_counts(documents: DataFrame, width: int) -> DataFrame:
    """(pair, docs, best): in how many rows of ``documents`` (pairs array) a pair is, and whether no pair with its first id is in more."""
    counts = cut_lineage(documents.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs")), "pairs")
    first = F.floor(F.col("pair") / width)
    # One row per entry of the first vocabulary at most.
    most = counts.groupBy(first.alias("__first")).agg(F.max("docs").alias("__most"))
    return counts.join(F.broadcast(most), first == F.col("__first")).select("pair", "docs", (F.col("docs") == F.col("__most")).alias("best"))


def scored(docs: DataFrame, first: str = BYTES, second: str = PIECES, hot: int = HOT) -> DataFrame:
    """``aligned`` without pairs, with ``groups_sha256``, ``n_best`` and ``count_sum`` by the whole corpus' counts.

    ``count_sum`` adds up, over a document's links, in how many documents the link's pair of ids is
    linked; ``n_best`` counts the links whose pair has the most of any with its first id.  Null and
    empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens: all
    zeros and an empty ``groups_sha256``.  Every repeated row counts as a document, a null doc_id stays null, a very
    long text is multiplied in blocks of rows, no documents give no rows, and other columns are not read.

    Pairs that are in at least one of ``hot`` of all (document, pair) rows number at most ``hot`` and
    are broadcast; the rows of rarer pairs, none of which is frequent, meet their counts by a shuffle.
    """
    width = _pair(first, second).width_b
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    rows = aligned(docs, first, second).withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id())
    rows = cut_lineage(rows, "aligned")
    counts = cut_lineage(pair_counts(rows, width), "counts")
    total = counts.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    limit = -(-total // hot)
    held = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    met = held.join(F.broadcast(counts.where(F.col("docs") >= limit)), "pair", "left")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("docs")).cast("long").alias("count_sum")]
    often = met.where(F.col("docs").isNotNull()).groupBy("row").agg(*sums)
    rare = met.where(F.col("docs").isNull()).select("row", "pair", "times").join(counts.where(F.col("docs") < limit), "pair").groupBy("row").agg(*sums)
    both = often.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    narrow = rows.drop("pairs", "times")
    return narrow.join(both, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


def links(docs: DataFrame, kind: str = "overlap", first: str = BYTES, second: str = PIECES) -> DataFrame:
    """(doc_id, a, b, a_id, b_id, value): linked token numbers of every text, with their ids.

    ``kind`` overlap links tokens that share bytes, ``value`` counting them; group links tokens of one
    group, ``value`` is 1.  Rows leave in blocks, so a very long text's links are never held at once.
    """
    if kind not in ("overlap", "group"):
        raise ValueError(f"no such links: {kind}")
    id_kind = dict(docs.dtypes)["doc_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(first, second)
        for batch in batches:
            for n, raw in enumerate(batch.column(1).to_pylist()):
                text = _read(raw)
                found = pair.tokens(segments_of(text)) if text else [None]
                if None in found:
                    continue
                a, b = (np.array([i for t in found for i in t[k]], np.int64) for k in (0, 1))
                size_a, size_b = (np.array([len(table[i]) for i in ids.tolist()], np.int64) for table, ids in ((pair.bytes_a, a), (pair.bytes_b, b)))
                left, right = byte_incidence(size_a), byte_incidence(size_b)
                if kind == "group":
                    group_a, group_b, count = groups_of(size_a, size_b)
                    left, right = group_incidence(group_a, count), group_incidence(group_b, count)
                for row, column, value in left.times(right.transposed()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[n].as_py()] * len(row), batch.schema.field(0).type), pa.array(row), pa.array(column), pa.array(a[row]), pa.array(b[column]), pa.array(value)],
                        ["doc_id", "a", "b", "a_id", "b_id", "value"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        rows, f"doc_id {id_kind}, a long, b long, a_id long, b_id long, value long")

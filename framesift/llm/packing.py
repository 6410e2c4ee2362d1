"""Packing documents into training sequences along a space-filling curve.

Every document becomes token ids and an end mark.  The ids, hashed into a signed count vector, are
projected to ``DIMS`` numbers; these are evened out by the corpus' own means and deviations and
give a position on a Hilbert curve.  Documents with similar words so lie near each other on the
curve.  They are sorted along it by ranges, laid end to end, and the line is cut every ``LENGTH`` ids.
What is left at the end of the line is cut into powers of two, so no sequence is padded.

A range of the curve is cut by the curve position and then by a hash of the row, so many copies of a
text, which share one position, spread over ranges; only totals per range are summed up globally.

Ids come from an installed public tokenizer.  It drops white space and never joins what white space
parts, so each distinct word of a batch is encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from struct import pack
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.ordinal import running, sampled_bucket
from framesift.session import cut_lineage

TOKENIZER, END, LENGTH = "word_bpe_49k.json", 1, 2048
#: Length of the hashed vector, numbers kept of it, bits of each on the curve, seed of hash and projection.
HASHED, DIMS, BITS, SEED = 256, 3, 13, 17
#: Bits of the row hash under the curve position, words and their longest length that a task remembers, documents whose vectors are made at once.
SPREAD, REMEMBERED, LONGEST, DOCUMENTS = 24, 400_000, 64, 1000
#: A control character that parts words on their way through the tokenizer, words at once, and bytes of text at a time.
MARK, AT_ONCE, AT_A_TIME = b"\x01", 1000, 2 << 20
#: Marks that end words; every ASCII character that is no letter, digit or white space shows as a full stop in the table.
_ENDS = b".,;:!?"
_STOPS = bytes(c if c >= 128 or chr(c).isalnum() or chr(c).isspace() else 46 for c in range(256))


class Encoder:
    """Ids of a text by a tokenizer file, as little-endian unsigned 32-bit bytes."""

    def __init__(self, name: str = TOKENIZER):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model = self.tokenizer.model
        # The byte-level alphabet shows a byte as the character of that number where it is printable, others from U+0100 on.
        plain = sorted(ord(c) for c in pre_tokenizers.ByteLevel.alphabet() if ord(c) < 256)
        self.shown = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.seen: dict[bytes, bytes] = {}
        alone = self.ids(MARK.decode())
        # Where the mark is no single token, -1 is found nowhere and every word is encoded by itself.
        self.mark = int(alone[0]) if len(alone) == 1 else -1

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def words(raw: bytes) -> list[bytes]:
        """Words that give the text's ids one after another: cut at ASCII white space, and plain texts at single end marks too."""
        if raw.isascii() and b"<|" not in raw and b".." not in raw.translate(_STOPS):
            raw = raw.lower()
            for c in _ENDS:
                if c in raw:
                    raw = raw.replace(bytes([c]), b" %c " % c)
        return raw.split()

    @staticmethod
    def stem(word: bytes) -> tuple[bytes, bytes]:
        """A word without the marks at its end, which are a token run of their own after a letter or digit, and these marks."""
        text = word.decode("utf-8", "replace").rstrip(_ENDS.decode())
        # Letters further on may lower or decompose to one that ends in a combining mark, which would join the run.
        if not text or not (text[-1] in "0123456789" or (text[-1] < "\u0250" and text[-1].lower().isalpha())):
            return word, b""
        cut = len(text.encode())
        return word[:cut], word[cut:]

    def plain(self, word: bytes) -> str | None:
        """Word as the tokenizer's model gets it, where that is plain: letters of the Latin blocks, composed."""
        if len(word) > LONGEST:
            return None
        if word.isalpha():
            return word.decode().lower()
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0250" and is_normalized("NFC", text) and (low := text.lower()).isalpha():
            return low.encode().decode("latin-1").translate(self.shown)
        return None

    def learn(self, words: set[bytes]) -> None:
        """Puts the ids of new words into memory.

        Plain words are what the model itself works on.  Others go through the whole tokenizer
        many at a time, with a mark between them that is a token of its own.
        """
        seen, one, rest, ended = self.seen, self.model.tokenize, [], []

        def put(w: bytes) -> None:
            low = self.plain(w) if b"<|" not in w else None
            if low is None:
                rest.append(w)
            else:
                found = one(low)
                seen[w] = pack(f"<{len(found)}I", *[t.id for t in found])

        for w in words:
            if w.isalpha() and len(w) <= LONGEST:
                found = one(w.decode().lower())
                seen[w] = pack(f"<{len(found)}I", *[t.id for t in found])
                continue
            if w[-1] not in _ENDS:
                put(w)
                continue
            ended.append((w, *self.stem(w)))
            for x in ended[-1][1:]:
                if x and x not in seen:
                    put(x)
        odd = []
        for i in range(0, len(rest), AT_ONCE):
            some = rest[i: i + AT_ONCE]
            ids = self.ids(f" {MARK.decode()} ".join([w.decode("utf-8", "replace") for w in some]))
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            if len(ends) != len(some):
                odd += some
                continue
            raw, first = ids.tobytes(), 0
            for w, end in zip(some, ends.tolist()):
                seen[w] = raw[4 * first: 4 * end]
                first = end + 1
        for w in odd:
            seen[w] = self.ids(w.decode("utf-8", "replace")).tobytes()
        for w, stem, marks in ended:
            seen[w] = seen[stem] + (seen[marks] if marks else b"")

    def texts(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each whole text (UTF-8 bytes; null is empty)."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):
            # Some megabytes of words at a time.
            size, words = 0, []
            while i < len(texts) and size < AT_A_TIME:
                words.append(self.words(texts[i]) if texts[i] else [])
                size += len(texts[i] or b"")
                i += 1
            here = set().union(*words)
            self.learn(here.difference(self.seen))
            get = self.seen.__getitem__
            out += [b"".join(map(get, ws)) for ws in words]
            if len(self.seen) > REMEMBERED:  # what was just met is likely to be met again
                self.seen = {w: self.seen[w] for w in here if len(w) <= LONGEST}
        return out


@lru_cache(maxsize=2)
def _encoder(name: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(name)


@lru_cache(maxsize=2)
def _projection() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers of the hash and the projection matrix; the same in every task."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, 2, np.uint64) | np.uint64(1), rng.standard_normal((HASHED, DIMS)) / np.sqrt(HASHED)


@lru_cache(maxsize=2)
def _hashed(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of every id below ``size`` in the hashed vector."""
    odd, _ = _projection()
    h = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * odd[0] + odd[1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) % np.uint64(HASHED)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def hashed_vectors(ids: list[np.ndarray], size: int) -> np.ndarray:
    """Per document, signed counts of its hashed ids, dampened by a logarithm and of length one; no ids give zeros."""
    slot, sign = _hashed(size)
    lengths = np.array(list(map(len, ids)), np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    v = np.bincount(np.repeat(np.arange(len(ids)) * HASHED, lengths) + slot[flat], sign[flat], len(ids) * HASHED).reshape(len(ids), HASHED)
    v = np.sign(v) * np.log1p(np.abs(v))
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (rows of ``axes``, each number below 2**bits).

    Neighbouring positions are points that differ by one in one axis.
    """
    x = axes.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    # From the highest bit down: undo the rotations of the cells that hold a point.
    for b in range(bits - 1, 0, -1):
        high, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(n):
            flip = (x[i] & high) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        fix ^= np.where(x[n - 1] & (one << np.uint64(b)), (one << np.uint64(b)) - one, np.uint64(0))
    x ^= fix
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << one | x[i] >> np.uint64(b) & one
    return out.astype(np.int64)


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """(doc_id, ids binary, tokens, p0 …): ids with the end mark as little-endian 16- or 32-bit numbers, and the projected vector."""
    kind = dict(docs.dtypes)["doc_id"]
    axes = [f"p{i}" for i in range(DIMS)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        _, matrix = _projection()
        size = max(encoder.tokenizer.get_vocab_size(), end + 1)
        narrow = size <= 1 << 16
        mark = np.array([end], "<u4").tobytes()
        for b in batches:
            ids = [np.frombuffer(x + mark, "<u4") for x in encoder.texts(b.column(1).to_pylist())]
            point = np.concatenate([np.zeros((0, DIMS)), *[hashed_vectors([x[:-1] for x in ids[k: k + DOCUMENTS]], size) @ matrix for k in range(0, len(ids), DOCUMENTS)]])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([(x.astype("<u2") if narrow else x).tobytes() for x in ids], pa.binary()),
                 pa.array([len(x) for x in ids], pa.int64()), pa.array([2 if narrow else 4] * len(ids), pa.int32()),
                 *[pa.array(point[:, i]) for i in range(DIMS)]], ["doc_id", "ids", "tokens", "width", *axes])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        rows, f"doc_id {kind}, ids binary, tokens long, width int, " + ", ".join(f"{a} double" for a in axes))


def curve_key(points: list[str], middle: list[float], spread: list[float]) -> Column:
    """Curve position of a point: each axis goes through a logistic curve of its standard score, which evens it out."""

    @F.pandas_udf("long")
    def key(*columns: pd.Series) -> pd.Series:
        axes = np.stack([c.to_numpy(float) for c in columns], 1)
        score = (axes - np.array(middle)) / np.array(spread)
        even = 1.0 / (1.0 + np.exp(np.clip(-1.7 * score, -50, 50)))
        return pd.Series(hilbert(np.minimum(even * (1 << BITS), (1 << BITS) - 1).astype(np.uint64)))

    return key(*points)


def cuts(total: int, length: int = LENGTH) -> tuple[int, list[int]]:
    """Whole sequences of a line of ``total`` ids, and the falling powers of two that make up the rest."""
    full, rest = divmod(total, length)
    return full, [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces_of(start: int, tokens: int, full: int, tail: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset in it) of a document that begins at ``start`` on the line."""
    out, at, stop = [], start, start + tokens
    while at < stop:
        seq, offset = divmod(at, length)
        size = length
        if seq >= full:
            first, seq = full * length, full
            for size in tail:
                if at < first + size:
                    break
                first, seq = first + size, seq + 1
            offset = at - first
        take = min(stop - at, size - offset)
        out.append((at - start, take, seq, offset))
        at += take
    return out


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, curve.

    A document's ids and its end mark lie end to end in its pieces; ``start`` counts the ids before a
    piece.  A sequence holds ``length`` ids; only the last ones are shorter and each a power of two.
    Null and empty texts are the end mark alone.  Repeated rows are documents of their own, a null
    doc_id stays null, a very long text goes through many sequences, and no documents give no rows.
    Documents at one curve position (copies) follow each other in the order of a hash.  Other columns
    are not read.
    """
    axes = [f"p{i}" for i in range(DIMS)]
    rows = cut_lineage(encoded(docs, tokenizer, end).withColumn("row", F.monotonically_increasing_id()), "encoded")
    stats = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), *[F.avg(a).alias(f"m_{a}") for a in axes], *[F.stddev_pop(a).alias(f"s_{a}") for a in axes]).first()
    full, tail = cuts(stats.total, length)
    curve = curve_key(axes, [stats[f"m_{a}"] or 0.0 for a in axes], [stats[f"s_{a}"] or 1.0 for a in axes])
    order = F.shiftleft("curve", SPREAD).bitwiseOR(F.shiftrightunsigned(F.xxhash64("row"), 64 - SPREAD))
    # The small columns are written for the cut points; the ids go through one shuffle.
    keyed = rows.withColumn("curve", curve).withColumn("at", order).drop(*axes)
    placed = running(keyed, [F.col("at"), F.col("row")], sampled_bucket(keyed, [F.col("at")]), value=F.col("tokens"), name="stop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple] = []
            for doc_id, ids, width, tokens, stop, position in zip(*[b.column(i).to_pylist() for i in range(6)]):
                whole = np.frombuffer(ids, f"<u{width}")
                for start, size, seq, offset in pieces_of(stop - tokens, tokens, full, tail, length):
                    found.append((doc_id, start, size, whole[start: start + size].astype("<u4").tobytes(), tokens, seq, offset, position))
            columns = list(zip(*found)) if found else [[]] * 8
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "curve"])

    kind = dict(docs.dtypes)["doc_id"]
    return placed.select("doc_id", "ids", "width", "tokens", "stop", "curve").mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, curve long")


def sequences(pieces: DataFrame, length: int = LENGTH, padding: int = 0) -> DataFrame:
    """(sequence_id, used, ids binary): the pieces of each sequence in order, padded to ``length`` unless of a power of two."""
    order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"), order.alias("p"))
    joined = F.aggregate(F.transform("p", lambda p: F.hex(p["ids"])), F.lit(""), lambda a, b: F.concat(a, b))
    pad = F.when(F.col("used").bitwiseAND(F.col("used") - 1) == 0, 0).otherwise(length - F.col("used")).cast("int")
    mark = np.array([padding], "<u4").tobytes().hex().upper()
    return whole.select("sequence_id", "used", F.unhex(F.concat(joined, F.repeat(F.lit(mark), pad))).alias("ids"))

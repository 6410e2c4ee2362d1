"""Packing: ids against the tokenizer itself, the curve, cuts and whole sequences, and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.llm import common, packing, queries
from tests.llm.test_operators import SF, empty, odd_rows, rows_of  # noqa: F401


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder()


def test_words_give_the_ids_of_the_whole_text(encoder):
    odd = ["a \x01 b\x01 \x01c", "it's  they'RE x", "ÉCOLE é ́x", "ΟΔΟΣ ΣΑΣ", "a\x1cb \x85c", "<|endoftext|>x y<|startoftext|> <|endoftext|>", "İstanbul",
           "日本 語　x", "x" * 50000, "", " \n\t", "ﬁ ﬂ", "a᠎b", "q 1234 5.6%", "a\x00b", "End. END, end... end?! é. 7. ... ,, a.b. it's. x'.", "<|ENDOFTEXT|> <|ENDOFTEXT|>. a<|endoftext|>b, J\u030c I\u0307.", "AbC" * 40 + ".", "été. ÉTÉ, Straße ẞ ß. ÿ Ÿ; Ω. ª º µ. 你好. x². ½, a.b,c d.e", "\x01. a\x01.", "İ. ǰ J\u030c ŉ."]
    odd += [r.text for r in [*map(lambda t: type("R", (), {"text": t}), [x[1] for x in odd_rows() if x[1]])]]
    for _ in range(2):  # the second time from memory
        for t, got in zip(odd, encoder.texts([t.encode() for t in odd])):
            assert got == encoder.ids(t).tobytes(), t[:40]


def test_memory_of_words_is_bounded_and_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    monkeypatch.setattr(packing, "AT_A_TIME", 10)
    small = packing.Encoder()
    texts = ["one two three four", "five six seven eight nine", "one six ten", "", "two two"]
    assert small.texts([t.encode() for t in texts]) == [encoder.ids(t).tobytes() for t in texts] and len(small.seen) <= 10


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_point_in_steps_of_one(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = packing.hilbert(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("sizes", [[1], [2048], [5, 5000, 1, 90], [2048 * 3, 7], [1023, 1, 1024], []])
def test_cuts_hold_every_id_once(sizes):
    full, tail = packing.cuts(sum(sizes))
    at, held = 0, {}
    for n in sizes:
        got = packing.pieces_of(at, n, full, tail)
        assert [g[0] for g in got] == [0, *np.cumsum([g[1] for g in got])[:-1]] and sum(g[1] for g in got) == n
        for _, size, seq, offset in got:
            assert held.get(seq, 0) == offset
            held[seq] = offset + size
        at += n
    assert sorted(held) == list(range(len(held)))
    assert all(n == 2048 or n & (n - 1) == 0 for n in held.values()) and sum(n < 2048 for n in held.values()) <= 11


def checked(rows, texts, encoder):
    """Every id of every document row in exactly one piece, sequences gapless and whole."""
    want = sorted(((i is None, i or 0), encoder.ids(t or "").tobytes() + b"\x01\0\0\0") for i, t in texts)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for held in by_seq.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [0, *np.cumsum([r.length for r in held])[:-1].tolist()]
        n = sum(r.length for r in held)
        assert n == 2048 or (n < 2048 and n & (n - 1) == 0)
    line = [r for s in sorted(by_seq) for r in by_seq[s]]
    got, current = [], None
    for r in line:  # documents follow each other whole on the line
        if r.start == 0:
            current = [r.doc_id, b"", r.doc_tokens]
            got.append(current)
        assert current[0] == r.doc_id and len(current[1]) == 4 * r.start
        current[1] += bytes(r.ids)
    assert all(len(g[1]) == 4 * g[2] for g in got)
    assert sorted(((g[0] is None, g[0] or 0), g[1]) for g in got) == want
    return got


def test_all_documents_are_packed_once(spark, encoder):
    docs = common.table(spark, SF, "documents")
    pieces = packing.packed(docs).cache()
    got = checked(pieces.collect(), [(r.doc_id, r.text) for r in docs.collect()], encoder)
    assert len(got) == docs.count()
    whole = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert all(len(r.ids) == 4 * r.used for r in whole.values())
    line = b"".join(bytes(whole[s].ids) for s in sorted(whole))
    assert line == b"".join(g[1] for g in got)
    digest = {(r.doc_id, r.start): r for r in queries.op13_packing(spark, SF).collect()}
    for r in pieces.collect():
        d = digest[r.doc_id, r.start]
        assert (d.length, d.ids_crc32, d.doc_tokens, d.sequence_id, d.offset) == (r.length, zlib.crc32(bytes(r.ids)), r.doc_tokens, r.sequence_id, r.offset)


def test_documents_of_like_words_are_neighbours(spark):
    """Documents of two vocabularies, mixed: along the curve they part into two runs, nearly."""
    kinds = [("alpha beta gamma delta epsilon zeta".split(), 0), ("copper silver golden iron bronze steel".split(), 1)]
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(kinds[i % 2][0], 60))) for i in range(200)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).where("start = 0").orderBy("sequence_id", "offset").collect()
    kind = [r.doc_id % 2 for r in got]
    assert sum(a != b for a, b in zip(kind, kind[1:])) < 60  # 100 at random


def test_odd_rows_and_clashing_columns(spark, encoder):
    rows = odd_rows()
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.lit("x") for n in (
        "ids", "tokens", "row", "curve", "at", "stop", "start", "length", "offset", "p0", "width", "__bucket")})
    got = packing.packed(odd)
    assert got.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "curve"]
    checked(got.collect(), [(r[0], r[1]) for r in rows], encoder)
    assert packing.packed(empty(spark)).count() == 0


def test_a_third_of_all_rows_at_one_point_of_the_curve(spark, encoder):
    rows = [(i, "the same text again" if i % 3 else f"text number {i}") for i in range(900)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"))
    checked(got.collect(), rows, encoder)


def test_padding_where_a_sequence_is_no_power_of_two(spark):
    piece = lambda seq, offset, ids: (seq, offset, len(ids), np.array(ids, "<u4").tobytes())
    rows = spark.createDataFrame([piece(0, 0, [5]), piece(0, 1, [6, 7]), piece(1, 0, [8] * 4), piece(2, 0, [9] * 8)],
                                 "sequence_id long, offset long, length long, ids binary")
    got = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(rows, 8, 3).collect()}
    assert got == {0: [5, 6, 7, 3, 3, 3, 3, 3], 1: [8] * 4, 2: [9] * 8}

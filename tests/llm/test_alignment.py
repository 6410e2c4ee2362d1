"""Alignment: sparse products against dense ones, and the whole query against token by token loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.llm import alignment, common, queries
from tests.llm.test_operators import SF, empty, odd_rows


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair()


def slow_tokens(pair, text):
    """Ids and bytes of a whole text by both, not cut into segments."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    shown = {c: i for i, c in enumerate([*range(33, 127), *range(161, 173), *range(174, 256)])}
    byte_of = {chr(c): c for c in shown}
    byte_of |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    raw_a = [bytes(byte_of[c] for c in pair.a.id_to_token(i)) for i in a]
    raw_b = [bytes([int(p[3:5], 16)]) if pair.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pair.b.id_to_piece(i)) for i in b)]
    whole = (" " + text).encode()
    return (a, raw_a, b, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else None


def brute(pair, docs):
    every, count, most = [], Counter(), defaultdict(int)
    for doc_id, text in docs:
        got = slow_tokens(pair, text)
        if got is None:
            every.append((doc_id, None))
            continue
        a, raw_a, b, raw_b = got
        ends_a, ends_b = np.cumsum([*map(len, raw_a)]), np.cumsum([*map(len, raw_b)])
        starts_a, starts_b = ends_a - [*map(len, raw_a)], ends_b - [*map(len, raw_b)]
        links = []
        for i in range(len(a)):
            lo, hi = np.searchsorted(ends_b, starts_a[i], "right"), np.searchsorted(starts_b, ends_a[i], "left")
            links += [(a[i], b[j]) for j in range(lo, hi)]
        groups, both = [], sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        before = 0
        for c in both:
            groups.append(",".join(str(x) for x, s, e in zip(a, starts_a, ends_a) if before <= s and e <= c) + "|" + ",".join(str(x) for x, s, e in zip(b, starts_b, ends_b) if before <= s and e <= c)
                          if len(a) < 3000 else None)
            before = c
        count.update(set(links))
        every.append((doc_id, (len(a), len(b), len(both), links, groups)))
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for doc_id, got in every:
        if got is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = got
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else "long"
        out.append((doc_id, n_a, n_b, n_groups, len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows(df, long=()):
    return sorted(((*r[:-1], "long" if r[0] in long else r[-1]) for r in map(tuple, df.select(*COLUMNS).collect())), key=repr)


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    for at_once in (1, 7, 1 << 20):
        x, y = rng.integers(0, 3, (9, 6)) * (rng.random((9, 6)) < 0.4), rng.integers(0, 3, (6, 8)) * (rng.random((6, 8)) < 0.4)

        def csr(m):
            r, c = np.nonzero(m)
            return alignment.Csr(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), c, m[r, c], m.shape[1])

        got = np.zeros((9, 8), int)
        for r, c, v in csr(x).times(csr(y), at_once):
            got[r, c] += v
        assert (got == x @ y).all()
        back = csr(x).transposed()
        dense = np.zeros((6, 9), int)
        dense[np.repeat(np.arange(6), np.diff(back.start)), back.columns] = back.values
        assert (dense == x.T).all()
        assert csr(x).products(csr(y)).tolist() == ((x != 0).astype(int) @ (y != 0).astype(int)).sum(1).tolist()


def test_whole_query_equals_token_by_token(spark, pair):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    long = {i for i, t in docs if t and len(pair.a.encode(" " + t, add_special_tokens=False).ids) >= 3000}
    assert rows(queries.op11_alignment(spark, SF), long) == brute(pair, docs)


ODD = ["  lead", "trail  ", "a  b\n c \n\nd", "x　 y  z", "<|endoftext|> and <0x41> <s> </s> <unk>", "é ́ x", "日本 語 🙂 👩‍👩‍👧", "a▁ ▁b ▁▁", "tab\t x", "\r\n a",
       "'s 't ' s 'll", "1 2 34 5", "x\x00 y", "﻿ b", "ﬁ ﬂ", "a᠎ b", "…", " ", "naïve façade", "x" * 3000 + " " + "ab1" * 700, "the same", "the same"]


@pytest.mark.parametrize("hot", [1, 20, 1 << 18])
def test_odd_texts_rows_and_columns(spark, pair, hot, monkeypatch):
    docs = [*((r[0], r[1]) for r in odd_rows() if not r[1] or len(r[1]) < 10000), *((100 + i, t) for i, t in enumerate(ODD))]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in (
        "n_a", "row", "pairs", "times", "pair", "docs", "best", "groups", "e", "__first")})
    assert rows(alignment.scored(table, hot=hot)) == brute(pair, docs)


def test_forgetting_changes_nothing(pair, monkeypatch):
    texts = [*ODD, None, "", "one two three", "two three four five"]
    want = list(pair.texts(texts))
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    monkeypatch.setattr(alignment, "AT_A_TIME", 20)
    small = alignment.Pair()
    assert list(small.texts(texts)) == want and len(small.seen) <= 30 and list(pair.texts(texts)) == want


def test_bytes_that_are_no_text_and_empty_tables(spark):
    table = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe")), (2, bytearray(b"fine"))], "doc_id long, text binary")
    got = {r.doc_id: r for r in alignment.scored(table).collect()}
    assert got[1].n_a == 0 and got[1].groups_sha256 == "" and got[2].n_a > 0
    assert alignment.scored(empty(spark)).count() == 0 and alignment.links(empty(spark)).count() == 0


def test_links_of_both_kinds(spark, pair):
    texts = [(1, "the unbelievable naïveté of it"), (2, None), (3, "  two  spaces\n"), (4, "🙂"), (5, "a▁b")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    overlap, group = (alignment.links(table, k).collect() for k in ("overlap", "group"))
    for doc_id, text in texts:
        got = slow_tokens(pair, text)
        if got is None:
            assert not [r for r in overlap + group if r.doc_id == doc_id]
            continue
        a, raw_a, b, raw_b = got
        owner_a, owner_b = (np.repeat(np.arange(len(x)), [*map(len, x)]) for x in (raw_a, raw_b))
        want = Counter(zip(owner_a.tolist(), owner_b.tolist()))
        assert {(r.a, r.b): r.value for r in overlap if r.doc_id == doc_id} == want
        assert all((a[r.a], b[r.b]) == (r.a_id, r.b_id) for r in overlap + group if r.doc_id == doc_id)
        ends = sorted(set(np.cumsum([*map(len, raw_a)]).tolist()) & set(np.cumsum([*map(len, raw_b)]).tolist()))
        of = lambda raw: np.searchsorted(ends, np.cumsum([*map(len, raw)]))
        shared = {(i, j) for i, x in enumerate(of(raw_a)) for j, y in enumerate(of(raw_b)) if x == y}
        assert {(r.a, r.b) for r in group if r.doc_id == doc_id} == shared
        [counted] = alignment.aligned(table).where(F.col("doc_id") == doc_id).collect()
        assert counted.n_shared == len(shared) and counted.n_links == len(want)
    with pytest.raises(ValueError):
        alignment.links(table, "none")

"""Ranked search: NRA against scores of all documents, bounds, shards, SQL, and odd rows."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.llm import common, queries, ranked
from tests.llm.test_operators import SF, empty, odd_rows


def slow_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=10):
    """Rows (item_id, rank, doc_id, score) by scoring every document for every item."""
    held = [(i, Counter(slow_terms(t))) for i, t in docs]
    n = [sum(c.values()) for _, c in held]
    count, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item_id, text in items:
        want, found = Counter(slow_terms(text)), []
        for (i, c), size in zip(held, n):
            m = 100 - 75 + 75 * size * count // total if total else 0
            s = sum(q * w[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in want.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item_id, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms_equal_the_pattern():
    for t in ["A b-C_d9 É日本 ü.x", "", None, " ", "a\x85b\xa0c d", "x\x7fy{z}^`", "İ ΑΒ ÀÉ"]:
        assert [x.decode() for x in ranked.terms(t.encode() if t is not None else None)] == slow_terms(t)


def test_whole_query_equals_brute_force_and_sql(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    got = rows(queries.op12_ranked_search(spark, SF))
    assert got == brute(docs, items)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = con.sql(queries.ORACLES["op12_ranked_search"])
    assert sorted(sql.select("item_id, rank, doc_id, score").fetchall(), key=repr) == got


@pytest.mark.parametrize("fragment, shard", [(7, 1 << 20), (1 << 15, 60), (50, 1)])
def test_fragments_and_shards_change_nothing(spark, monkeypatch, fragment, shard):
    monkeypatch.setattr(ranked, "DOCUMENTS", fragment)
    rng = np.random.default_rng(fragment)
    vocabulary = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 40)), p=p / p.sum()))) for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, 6))) for i in range(9)]
    got = ranked.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), shard_bytes=shard)
    assert rows(got) == brute(docs, items)


def random_fragment(seed, documents=4000, words=40):
    rng = np.random.default_rng(seed)
    doc, term = np.unique(np.stack([rng.integers(0, documents, 30000), (rng.pareto(1.0, 30000) * 3).astype(int) % words]), axis=1)
    n = rng.integers(1, 200, documents)
    times = rng.integers(1, 6, len(doc))
    weight = rng.integers(0, 9000, words)
    return ranked.Fragment(n, doc, term, times, weight, documents, int(n.sum())), rng


@pytest.mark.parametrize("seed", range(8))
def test_best_of_a_fragment_is_whole_and_exact(seed):
    f, rng = random_fragment(seed)
    wanted = rng.choice(40, int(rng.integers(1, 25)), replace=False)
    times = rng.integers(1, 4, len(wanted))
    score = np.zeros(f.size, np.int64)
    for t, q in zip(wanted, times):
        s = slice(f.start[t], f.start[t + 1])
        score[f.doc[s]] += q * f.impact[s]
    for bar in (1, int(np.sort(score)[-3]), int(score.max()) + 1):
        docs, scores = f.best(wanted, times, 10, bar)
        assert (score[docs] == scores).all()
        last = max(bar, int(np.sort(score)[-10]))
        assert set(docs.tolist()) == set(np.flatnonzero((score >= last) & (score > 0)).tolist())


def test_a_rare_strong_term_ends_reading_early():
    """One term decides; of a long list of weak impacts only the top is read."""
    n = np.full(20000, 100)
    doc = np.concatenate([np.arange(20000), np.arange(30), np.arange(30)])
    term = np.repeat([0, 1, 2], [20000, 30, 30])
    f = ranked.Fragment(n, doc, term, np.ones(len(doc), np.int64), np.array([1, 9000, 8000]), 20000, 2_000_000)
    docs, _ = f.best(np.array([0, 1, 2]), np.array([1, 1, 1]), 10)
    assert set(docs.tolist()) == set(range(30)) and f.reads < 1000


def test_ties_repeats_and_odd_rows(spark):
    docs = [*((r[0], r[1]) for r in odd_rows()), *((i, "equal words here") for i in range(40, 20, -1)), (None, "equal words here"), (30, "equal words here")]
    items = [(1, "equal words"), (1, "equal words"), (None, "the moon and the cat"), (3, None), (4, ""), (5, "?!"), (6, "nowhere found"), (7, "fox " * 5000 + "moon")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "terms", "times", "item_id", "rank", "score", "part", "k", "item")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("raw", "doc_id", "score")})
    assert rows(ranked.ranked(table, bench)) == brute(docs, items)
    for d, i in ((empty(spark), bench), (table, bench.limit(0)), (spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), bench)):
        got = ranked.ranked(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0

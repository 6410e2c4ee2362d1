"""Training-data operators against brute force, held-out accuracy and the edge cases of their docstrings."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framesift.llm import ann, common, decontam, langid, licenses, mixing, nearsets, quality, queries, secrets, sharding, simhash, tokencount

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog and runs away from it " * 3000


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    plain = "the cat sat on the mat and looked at the moon"
    return [(1, plain, "en", "a", 1), (1, plain, "en", "a", 1), (2, plain, None, None, None), (3, None, "en", "a", 0), (None, "something with no id at all in it", "en", "b", 1),
            (4, "", "en", "a", 0), (5, " \n\t", "en", None, 3), (6, LONG, "en", "a", 9), (7, "12345 67890 %%% 42", "en", "b", 9), (8, "é", "fr", "b", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    # Columns whose names the operators use for themselves.
    return spark.createDataFrame(odd_rows(), DOC).withColumns({n: F.lit("x") for n in (
        "score", "shard", "row", "key", "fp", "mark", "topic", "tokens", "probability", "words", "label", "size", "draw", "root", "features", "h", "candidate")}).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents").cache()


def empty(spark):
    return spark.createDataFrame([], DOC)


def rows_of(df, *columns):
    return sorted(df.select(*columns).collect(), key=repr)


# sharding

def test_shards_are_even_and_keep_equal_texts_together(spark, docs):
    got = sharding.sharded(docs).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    where = {}
    for r in got:
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_hot_group_fills_as_few_shards_as_it_can(spark):
    rows = spark.range(600).select(F.col("id").alias("row"), F.when(F.col("id") < 240, F.array(F.lit("hot"))).when(F.col("id") < 300, F.array(F.concat(F.lit("g"), (F.col("id") % 20).cast("string")))).alias("keys"))
    got = sharding.assign(rows, 8).collect()
    assert set(Counter(r.shard for r in got).values()) == {75}
    hot = Counter(r.shard for r in got if r.row < 240)
    assert sum(sorted(hot.values(), reverse=True)[:4]) >= 230
    cut = sum(len({r.shard for r in got if 240 <= r.row < 300 and r.row % 20 == g}) - 1 for g in range(20))
    assert cut <= 6


def test_more_linked_rows_than_any_shard_holds(spark):
    rows = spark.range(101).select(F.col("id").alias("row"), F.array(F.lit("all")).alias("keys"))
    sizes = Counter(r.shard for r in sharding.assign(rows, 8).collect())
    assert sorted(sizes.values()) == [12, 12, 12, 13, 13, 13, 13, 13]


def test_few_linked_rows_in_a_large_table_meet(spark):
    """Six pairs and a group of three among 30,000 rows: what is settled does not depend on the rows without links."""
    key = F.when(F.col("id") < 12, F.array(F.concat(F.lit("p"), (F.col("id") % 6).cast("string")))).when(F.col("id") < 15, F.array(F.lit("three")))
    got = sharding.assign(spark.range(30_000).select(F.col("id").alias("row"), key.alias("keys")), 8).collect()
    where = {r.row: r.shard for r in got}
    assert set(Counter(where.values()).values()) == {3750}
    assert all(where[i] == where[i + 6] for i in range(6)) and where[12] == where[13] == where[14]


def test_shard_edges(spark, odd):
    got = sharding.sharded(odd).collect()
    assert len(got) == len(odd_rows()) and {r.size for r in got if r.text_crc32 == 0} == {1}
    assert all(r.grown_shard is None and r.law == "rows" for r in got)
    assert sharding.sharded(empty(spark)).count() == 0


# SimHash

def brute_components(ids, fps, radius=4):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.array(ids)
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def slow_fingerprint(text):
    import re

    import xxhash
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    parts = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    votes = Counter(b for p in parts for b in range(64) if xxhash.xxh64_intdigest(p.encode(), 42) >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(parts))


def test_fingerprints_and_components_equal_brute_force(docs):
    got = {r.doc_id: r for r in simhash.components(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(text)
    fps = np.array([slow_fingerprint(text[i]) for i in ids], np.uint64)
    assert [got[i].fingerprint for i in ids] == [f"{int(f):016x}" for f in fps]
    assert [got[i].component_id for i in ids] == brute_components(ids, fps).tolist()


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 8])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in rng.integers(0, 64, rng.integers(0, radius + 4)):
            b[i] ^= np.uint64(1) << np.uint64(k)
    assert (simhash.near_pairs_of(a, b, radius) == (np.bitwise_count(a ^ b) <= radius)).all()
    p, q = simhash.near_lanes(a, b, radius)
    assert set(zip(p, q)) == set(zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)))


def test_crowded_buckets_in_tiles(spark):
    """A ball of fingerprints and a chain, with tiles far smaller than the buckets."""
    rng = np.random.default_rng(4)
    ball = {int(np.uint64(0xABCDEF0123456789) ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False))) for _ in range(150)}
    chain, x = [], 1 << 40
    for k in range(0, 40, 4):
        chain.append(x)
        x ^= 0b1111 << k
    fps = np.array(sorted(ball | set(chain) | set(rng.integers(0, 2**62, 100).tolist())), np.uint64)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in common.smallest_reachable(simhash.near_links(df, len(fps), 4, tile=16)).collect()}
    signed = fps.view(np.int64)
    expected = brute_components(signed, fps)
    assert [roots.get(int(f), int(f)) for f in signed] == expected.tolist()


def test_simhash_edges(spark, odd):
    got = simhash.components(odd).collect()
    assert len(got) == len(odd_rows())
    assert {r.fingerprint for r in got if r.doc_id in (3, 4, 5)} == {"0" * 16} and {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 6, 7, 8]
    assert simhash.components(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0


def test_components_of_graphs(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.smallest_reachable(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: find(n) for n in nodes}


# near-duplicates by sets of shingles

def brute_near_sets(texts, width=5):
    """Smallest id of each group linked by a Jaccard similarity of 0.8 or more; ``texts`` is id to text."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k: k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    ids = sorted(sets)
    label = {i: i for i in ids}
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while True:
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return set(label.values())


def planted_copies():
    """Texts of 40 to 300 words with copies around a similarity of 0.8, chains of them, and a crowded group."""
    rng = np.random.default_rng(17)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for n in rng.integers(40, 300, 60):
        w = word(n)
        texts.append(w)
        for changed in (1, max(1, n // 60), max(1, n // 50), max(1, n // 40), max(1, n // 30), n // 10):
            v = list(w)
            for at in rng.choice(n, changed, replace=False):
                v[at] = "changed"
            texts.append(v)
    base = word(200)
    for _ in range(150):
        v = list(base)
        for at in rng.choice(200, 3, replace=False):
            v[at] = str(rng.integers(10**6))
        texts.append(v)
    for k in range(12):
        texts.append(base[8 * k:] + [f"x{j}" for j in range(8 * k)])
    rng.shuffle(order := list(range(len(texts))))
    return {i: " ".join(texts[k]) for i, k in enumerate(order)}


@pytest.mark.parametrize("tile, shingles, dense", [(512, 1 << 18, 16), (7, 1 << 18, 0), (512, 3000, 10**9)])
def test_near_duplicate_stage_equals_brute_force_jaccard(spark, docs, monkeypatch, tile, shingles, dense):
    monkeypatch.setattr(nearsets, "TILE", tile)
    monkeypatch.setattr(nearsets, "SHINGLES", shingles)
    monkeypatch.setattr(nearsets, "DENSE", dense)
    for texts in ({r.doc_id: r.text for r in docs.collect()}, planted_copies()):
        df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], DOC)
        kept = corpus_pipeline.deduplicated(spark, df, SF)
        assert kept.columns == df.columns
        got = [r.doc_id for r in kept.collect()]
        assert len(got) == len(set(got)) and set(got) == brute_near_sets(texts)


@pytest.mark.parametrize("dense", [0, 16, 10**9])
def test_forest_of_a_unit_joins_what_agrees(monkeypatch, dense):
    monkeypatch.setattr(nearsets, "DENSE", dense)
    rng = np.random.default_rng(dense)
    base = [np.unique(rng.integers(0, 10**6, 60)).astype(np.int64) for _ in range(12)]
    sets = []
    for k in range(300):
        s = base[k % 12].copy()
        s[rng.choice(len(s), int(rng.integers(0, 9)), replace=False)] = rng.integers(10**6, 10**9)
        sets.append(np.unique(s))
    n = len(sets)
    agree = np.array([[5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)) for y in sets] for x in sets])
    for root, side in ((np.arange(n), np.zeros(n, int)), (np.arange(n), np.arange(n) % 2), (np.arange(n) // 40, np.zeros(n, int))):
        i, j = nearsets.forest_of(root, side, np.array([len(s) for s in sets]), sets, (4, 5))
        assert all(agree[a, b] and root[a] != root[b] for a, b in zip(i, j)) and len(i) < len(set(root.tolist()))
        allowed = agree & ((side[:, None] != side[None, :]) | (side.min() == side.max())) | (root[:, None] == root[None, :])
        found = np.eye(n, dtype=bool) | (root[:, None] == root[None, :])
        found[i, j] = found[j, i] = True
        for m in (allowed, found):
            while True:
                step = (m.astype(int) @ m.astype(int)) > 0
                if (step == m).all():
                    break
                m[:] = step
        assert (allowed == found).all()


def test_near_duplicate_stage_compares_simhash_components(spark, monkeypatch):
    """Without any key of min-wise hashes, sets in one component of fingerprints are still compared, and only they."""
    monkeypatch.setattr(nearsets, "band_keys", lambda hashes: [])
    texts = planted_copies()
    # Equal fingerprints, one shingle repeated, but sets that have little in common.
    texts |= {10**6 + k: "again " * 400 + " ".join(f"v{k}x{j}" for j in range(30)) for k in range(3)}
    ids = sorted(texts)
    fps = np.array([simhash.fingerprint(texts[i].encode(), 5) for i in ids], np.uint64)
    assert len(set(fps[-3:])) == 1
    groups = {}
    for i, c in zip(ids, brute_components(ids, fps).tolist()):
        groups.setdefault(c, {})[i] = texts[i]
    expected = set().union(*(brute_near_sets(g) for g in groups.values()))
    assert len(expected) < len({frozenset(nearsets.shingle_set(t.encode()).tolist()) for t in texts.values()}) - 50
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], DOC)
    got = [r.doc_id for r in corpus_pipeline.deduplicated(spark, df, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and set(ids[-3:]) <= expected


def test_near_duplicate_stage_edges(spark, odd):
    kept = nearsets.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 6, 7, 8]
    assert nearsets.one_of_each(empty(spark)).count() == 0


# language

def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    w, codes, target = langid.initial(3, 4), rng.integers(0, 256, (5, 6)), rng.integers(0, 3, 6)
    _, g = langid.loss_and_gradient(w, codes, target)
    for k in w:
        i = (codes[2, 1], 5) if k in ("fx", "bx") else tuple(rng.integers(0, s) for s in w[k].shape)
        step = 1e-6
        w[k][i] += step
        up = langid.loss_and_gradient(w, codes, target)[0]
        w[k][i] -= 2 * step
        down = langid.loss_and_gradient(w, codes, target)[0]
        w[k][i] += step
        assert g[k][i] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-8)


@pytest.fixture(scope="module")
def net(spark):
    return langid.fit(common.table(spark, "/root/testdata/sf0.01", "documents").where(~common.held_out()))


def test_language_of_held_out_documents(spark, net):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").where(common.held_out())
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, net).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    assert np.mean([got[i] == true[i] for i in true]) >= 0.97


def test_windows_cover_every_byte_once(net):
    raw = [b"", b"a", b"ab " * 500, bytes(range(97, 123)) * 40]
    for r in raw:
        assert sum(int(inside.sum()) for inside in [langid._windows(r)[1]]) == len(r)
    alone = [langid.log_probabilities(net, [r])[0] for r in raw]
    assert np.allclose(langid.log_probabilities(net, raw), alone, atol=1e-4)


def test_language_edges(spark, odd, net):
    got = langid.predict(odd, net).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (3, 4, 5, 7) or (r.doc_id is None and r.score == 0))
    none = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.predict(empty(spark), net).count() == 0


# quality

def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op3_quality(spark, sf).collect()}
    labels = [(r.doc_id, r.quality) for r in common.table(spark, sf, "labels").collect() if got[r.doc_id].held_out]
    low = [got[i].score for i, q in labels if q == 0]
    high = [got[i].score for i, q in labels if q == 1]
    assert np.mean([h > x for h in high for x in low]) >= 0.97
    assert np.mean([s >= 0.3 for s in high]) >= 0.97


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.3, (60, quality.COLUMNS)).astype(np.float32)
    v = quality.latent(counts[:40], (np.arange(40) % 3 > 0).astype(float), np.ones(quality.COLUMNS, np.float32))
    got = v.score(counts)
    for x, s in zip(v.project(counts), got):
        cos = v.vectors @ x
        near = np.argsort(-cos)[:quality.NEIGHBOURS]
        w = np.exp(quality.SHARPNESS * (cos[near] - 1))
        assert s == pytest.approx((w * v.labels[near]).sum() / w.sum(), abs=1e-5)


def test_quality_edges(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (6, 0), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    v = quality.fit(odd, labels)
    got = quality.score(odd, v).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    none = quality.fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(empty(spark), v).count() == 0


# mixing

def test_raking_meets_the_marginals(spark):
    rng = np.random.default_rng(1)
    cells = [(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(50, 1000))) for a in range(4) for b in range(3) for c in range(2)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    wanted = {"source": {"s0": 0.2, "s1": 0.3, "s2": 0.25, "s3": 0.25}, "lang": {"l0": 0.4, "l1": 0.3, "l2": 0.3}, "topic": {"t0": 0.5, "t1": 0.5}}
    got = mixing.rake(df, keep=0.3, targets=wanted).collect()
    total = sum(c[3] for c in cells)
    for m, shares in wanted.items():
        for value, share in shares.items():
            assert sum(r.raked for r in got if r[m] == value) == pytest.approx(share * 0.3 * total, rel=1e-4)
    assert all(r.raked <= r.tokens + 1e-9 for r in got)


def test_mixing_edges(spark, odd):
    got = mixing.sampled(odd)
    assert got.count() == len(odd_rows())
    kept = mixing.mixture(odd)
    assert kept.columns == odd.columns and kept.count() == got.where("kept").count()
    assert mixing.sampled(empty(spark)).count() == 0 and mixing.mixture(empty(spark)).count() == 0


# token counts

def unigram(vocabulary, byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers
    t = Tokenizer(models.Unigram(vocabulary, 0, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_with_many_ties_equal_the_tokenizer(byte_fallback):
    vocabulary = [("<unk>", 0.0)] + [(a, -float(s)) for a, s in {"a": 2, "b": 2, "ab": 4, "aab": 6, "ba": 4, "▁": 1, "▁a": 3, "c": 5, "abc": 9, "é": 3, "bé": 5, "▁▁": 2}.items()]
    if byte_fallback:
        vocabulary += [(f"<0x{b:02X}>", -30.0) for b in range(256)]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ab cé▁x漢\n0")) for _ in range(rng.integers(0, 15))) for _ in range(1500)]
    counter = tokencount.Counter(vocabulary)
    assert [counter.text(t) for t in texts] == unigram(vocabulary, byte_fallback)(texts)


def test_counts_of_documents_equal_the_tokenizer(docs, odd, spark):
    every = [r.text for r in docs.collect()] + [r[1] for r in odd_rows()]
    oracle = unigram(tokencount.read_vocabulary(), True)
    counter = tokencount.Counter(tokencount.read_vocabulary())
    assert [counter.text(t) for t in every] == oracle([t or "" for t in every])
    got = tokencount.token_counts(odd).collect()
    assert sorted(r.tokens for r in got) == sorted(oracle([r[1] or "" for r in odd_rows()]))
    assert tokencount.token_counts(empty(spark)).count() == 0


# nearest neighbours

def exact(vectors, every, k):
    ids = np.array([v[0] for v in vectors])
    x = np.array([v[1] for v in vectors], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort([ids, -s]) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbour_recall_and_scores(spark):
    e = common.table(spark, "/root/testdata/sf0.01", "embeddings")
    truth = exact([(r.vec_id, r.embedding) for r in e.collect()], 20, 20)
    got = {}
    for r in ann.neighbours(e, shard=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(truth)
    hits = 0
    for q, rows in got.items():
        assert [r[0] for r in rows] == list(range(1, 21))
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        hits += len({r[1] for r in rows} & {v for v, _ in truth[q]})
    assert hits / (20 * len(truth)) >= 0.9


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 2**63, 4000).astype(np.uint64)
    codes[:500] = codes[0] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    for bits in (64, 40, 10):
        mine = codes & np.uint64((1 << bits) - 1)
        tables = ann.Tables(mine, bits)
        for radius in (0, 1, 2, 5, 9, 20, 30):
            for q in mine[:5]:
                assert tables.within(int(q), radius).tolist() == np.flatnonzero(np.bitwise_count(mine ^ q) <= radius).tolist()


def test_neighbours_with_uneven_lengths(spark):
    """Inner products, not angles: one vector is much longer than the others."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=16) * (1 + i % 7)).tolist()) for i in range(400)]
    truth = exact(rows, 20, 5)
    got = {}
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {v for v, _ in truth[q]}) / 5 for q in truth]) >= 0.9


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    same = [(20 * i, [1.0, 2.0]) for i in range(30)]
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (8, [1e200, 1e200]), (0, [1.0, 2.0])]
    got = ann.neighbours(spark.createDataFrame(same + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)), k=20).collect()
    for q in range(0, 600, 20):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        others = sorted([v for v, _ in same if v != q] + ([0] if q else []))
        assert [r[1] for r in mine] == ([8] + others)[:20] and [r[0] for r in mine] == list(range(1, 21))
    few = ann.neighbours(spark.createDataFrame([(0, [1.0]), (3, [2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(0, 1, 3, 2.0)]
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# decontamination

def brute_leaks(docs, items):
    out = set()
    for i, text in docs:
        w = decontam.words(text)
        for k, item in items:
            v = decontam.words(item)
            if not v:
                continue
            need = decontam.shingles(v)
            n = min(5, len(v))
            here = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)}
            if len(need & here) >= 0.8 * len(need) - 1e-9:
                out.add((i, k))
    return out


def test_leaks_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in common.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    rng = np.random.default_rng(9)
    for k, text in items:  # copies with some words changed, in a text of their own
        w = text.split()
        for wrong in (1, 2, max(1, len(w) // 6), len(w) // 2):
            at = int(rng.integers(0, len(w) - wrong + 1))
            docs.append((10**6 + len(docs), "before it " * 30 + " ".join(w[:at] + ["zzz"] * wrong + w[at + wrong:]).upper() + " after it" * 200))
    items += [(900, "two words"), (901, "Is this a question? Yes it is."), (902, " ... ")]
    docs += [(5, "here are two words"), (6, "two other words"), (7, "is this a question yes it is")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items + items[:3], "item_id long, text string")
    expected = brute_leaks(docs, items)
    for index in (decontam.contaminated(d, b), ):
        assert {(r.doc_id, r.item_id) for r in index.collect()} == expected
    assert len(decontam.indexes(b, shard=10)) > 1
    clean = decontam.clean(d, b)
    assert clean.columns == d.columns and clean.count() == len(docs) - len({i for i, _ in expected})


def test_question_and_answer():
    assert decontam.question_and_answer("What is it? A stone.")[1] == "A stone."
    assert decontam.question_and_answer("Q: what\nAnswer: forty two")[1] == " forty two"
    assert decontam.question_and_answer("no parts at all") == ("no parts at all", "")


def test_items_torn_apart_are_leaks_whatever_else_is_in_the_index():
    item = " ".join(f"q{i}" for i in range(30)) + "? " + " ".join(f"a{i}" for i in range(30))
    longer = " ".join(f"z{i}" for i in range(600))
    for apart in (10, 70, 500, 5000):
        text = "before " * 30 + " ".join(f"q{i}" for i in range(30)) + " other" * apart + " " + " ".join(f"a{i}" for i in range(30)) + " after" * 40
        for rows in ([(1, item)], [(1, item), (2, longer)]):
            df = {t: 1 for _, x in rows for t in decontam.words(x)}
            index = decontam.build(rows, len(rows), df, sum(len(decontam.words(x)) for _, x in rows) / len(rows))
            assert [(h[0], round(h[2], 4)) for h in decontam.search(text, index)] == [(1, round(52 / 56, 4))]


def test_language_stage_without_a_learned_language_drops_only_texts_without_a_letter(spark):
    import corpus_pipeline
    docs = spark.createDataFrame([(1, "ein Satz", None), (2, "12 34", None), (3, None, None), (4, "слово", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.identified(spark, docs, SF).collect()} == {1, 4}


def test_decontamination_edges(spark, odd):
    b = spark.createDataFrame([(1, "the cat sat on the mat and looked at the moon"), (None, "é"), (2, None), (3, "")], "item_id long, text string")
    got = decontam.contaminated(odd, b).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 1), (2, 1)]
    assert decontam.clean(odd, b).count() == len(odd_rows()) - 3
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(odd, none).count() == 0 and decontam.clean(odd, none).count() == len(odd_rows())
    assert decontam.contaminated(empty(spark), b).count() == 0


# secrets and licences

def test_secrets_of_held_out_documents(spark):
    got = queries.op2_secrets(spark, "/root/testdata/sf0.01").withColumn("out", common.held_out()).collect()
    text = {r.doc_id: r.text for r in common.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert got and all(text[r.doc_id][r.start: r.start + len(r.candidate)] == r.candidate for r in got)
    truth = lambda r: text[r.doc_id][: r.start].endswith('token = "')
    assert all(r.secret == truth(r) for r in got if r.out)


def test_candidates_equal_a_scan(spark, odd):
    import re
    texts = [(1, 'key="abcdefgh12345678" and /usr/lib/python3.12/site-packages/x, 1234567890123456'), (2, "a" * 40), (3, "x9" * 400 + " " + "y8" * 9), (4, None), (5, "")]
    got = sorted((r.doc_id, r.start, r.candidate) for r in secrets.candidates(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == sorted((i, m.start(), m.group()) for i, t in texts if t for m in re.finditer(secrets.CANDIDATE, t))
    assert secrets.scan(odd, ~common.held_out()).count() == 0
    assert secrets.scan(empty(spark), ~common.held_out()).count() == 0


def test_licences_of_held_out_documents(spark):
    import re
    sf = "/root/testdata/sf0.01"
    got = [r for r in queries.op9_licences(spark, sf).withColumn("out", common.held_out()).collect() if r.out]
    found = {(r.doc_id, r.nth): r for r in got}
    names = {"mit": r"MIT License", "apache": r"Apache License", "gpl": r"GNU General", "cc": r"CC BY"}
    for d in common.table(spark, sf, "documents").where(common.held_out()).collect():
        for nth, line in enumerate(d.text.split("\n")):
            family = next((f for f, p in names.items() if re.search(p, line)), None)
            if family:
                assert found[(d.doc_id, nth)].family == family and found[(d.doc_id, nth)].confirmed


def test_licence_edges(spark, odd):
    assert licenses.scan(odd, ~common.held_out()).where("confirmed").count() == 0
    assert licenses.scan(empty(spark), ~common.held_out()).count() == 0


def test_licence_words_and_grams_against_brute_force(spark):
    """Words keep inner dots and hyphens only; features are the distinct n-grams of one to three words."""
    texts = ["Apache License, Version 2.0.", "-- cc by-nc 4.0 --", "a", "a a a a", "..x..y-", "Ünï-cödé\tÉ", "to be or not to be"]
    rows = licenses.paragraphs(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", "--- . -", None])], "doc_id long, text string"))
    got = {r.doc_id: (r.words, r.features.numNonzeros()) for r in licenses._vectors(rows).collect()}

    def words(t):
        kept = "".join(c if c.isalnum() or c in ".-" else " " for c in t.lower()).split()
        return [w.strip(".-") for w in kept if w.strip(".-")]

    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        w = words(t)
        grams = {tuple(w[k: k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)}
        assert got[i] == (w, len(grams)), t


# pipeline

def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = common.table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = {r.doc_id: r for r in out.collect()}
        assert all(before[i] == r for i, r in rows.items())
        if name == "language":
            assert set(before) - set(rows) == {i for i, r in before.items() if not any(map(str.isalpha, r.text))}
        if name == "near_duplicates":
            assert set(rows) == brute_near_sets({i: r.text for i, r in before.items()})
        if name == "decontamination":
            bad = {i for i, _ in brute_leaks([(i, r.text) for i, r in before.items()], [(b.item_id, b.text) for b in common.table(spark, SF, "benchmark").collect()])}
            assert set(rows) == set(before) - bad
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
        before = rows
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(before)


def test_pipeline_edges(spark):
    docs = spark.createDataFrame(odd_rows(), DOC)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [c.split()[0] for c in DOC.split(", ")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_topics_of_long_runs_and_of_every_rule(spark):
    """Patterns give what their plain forms give, and a run of a million characters takes no longer than other texts."""
    import re
    import time
    plain = {"licence": r"(?i)licen[cs]ed? under|released under the|copyright", "credentials": r"(?i)(?:token|secret|password|api_?key)\s*[=:]\s*\S{8}",
             "table": r"(?:\|[^|\n]{1,80}){4}", "symbols": r"(?:\S*[%$&*#]{3}\s+){3}", "contact": r"[\w.+-]+@[\w-]+\.\w+"}
    texts = ["LICENSED UNDER x", "it is Copyright me", "released UNDER the", "API_KEY = abcdefgh1", "apikey:  12345678", "Token 12345678", "a|b|c|d|e", "|||||", "a%%% b$$$ c### d",
             "%%% %%% x%%%\n", "%%% b%% %%% ", "me.you@here.org", "@here.org", "a@b", "+@b-c.d", "plain words", "", "  \n", None, "x@y.z token=12345678", "under the copy right"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, "a" * 10**6), (101, "%" * 10**6), (102, "a@" * 300_000), (103, "%%% " + "b" * 10**6), (104, "|" + "c" * 10**6)]
    df = spark.createDataFrame(rows, "id long, text string")
    df.select(mixing.topic_of(F.lit("warm"))).collect()
    began = time.time()
    got = {r.id: r.topic for r in df.select("id", mixing.topic_of(F.col("text")).alias("topic")).collect()}
    assert time.time() - began < 20
    for i, t in enumerate(texts):
        want = mixing.NONE if not t or not t.strip() else next((n for n, p in plain.items() if re.search(p, t, re.ASCII)), "prose")
        assert got[i] == want, t
    assert {got[i] for i in range(100, 105)} == {"prose"}

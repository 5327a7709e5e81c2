"""N-gram join, components, nearest neighbours and top-k against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from grainmill.llm import _shards, hnsw, maxscore, ngram_join, registry, signature_tree
from grainmill.llm._shingles import keys_of, shingle_sets
from grainmill.llm import components as components_module
from grainmill.llm.components import components
from tests.compare import differences
from tests.llm import cases


def words_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(id, n, component) of each row, rows with equal ids being one node each."""
    sets = [words_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, n=90):
    """Chains of edited copies, shared passages, short texts and exact copies."""
    r = random.Random(seed)
    word = lambda: "w" + str(r.randint(0, 5000))
    passage = [word() for _ in range(60)]
    texts = []
    while len(texts) < n:
        kind = r.random()
        if kind < 0.5 and texts:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                if w:
                    w[r.randrange(len(w))] = word()
            texts.append(" ".join(w[: len(w) - r.choice([0, 0, 0, 3])]))
        elif kind < 0.65:
            texts.append(" ".join(passage + [word() for _ in range(r.randint(0, 80))]))
        elif kind < 0.75:
            texts.append(" ".join(word() for _ in range(r.randint(0, 6))))
        else:
            texts.append(" ".join(word() for _ in range(r.randint(20, 300))))
    return list(enumerate(texts))


def joined(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_against_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # blocks and hot keys even in small units
        for name, value in [("BLOCK_BYTES", 900), ("SET_BYTES", 5000), ("LEAST_BYTES", 500), ("HOT_IN_CHUNK", 2), ("HOT_ROWS", 3), ("CHUNK", 500), ("BROADCAST_BYTES", -1)]:
            monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(seed)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_ngram_join_over_tables(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.op2_ngram_join(spark, sf_dir).collect())
    assert got == brute(rows)


def test_ngram_join_matches_sql(spark, sf_dir):
    assert differences(ngram_join.op2_ngram_join(spark, sf_dir), registry.ORACLE_SQL["op2_ngram_join"], sf_dir) == ""


def test_ngram_join_cases(spark):
    df = cases.documents(spark)
    assert joined(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert joined(cases.empty(spark)) == Counter()


def test_ascii_case_and_white_space_of_words():
    a, b, c, d = shingle_sets([b"A b\x0bC\x0cd E f", b"a B c d e F", "É b c d e".encode(), "é b c d e".encode()])
    assert a.tolist() == b.tolist() and len(a) == 2 and c.tolist() != d.tolist()
    assert shingle_sets([b"x y"])[0].tolist() != shingle_sets([b"xy"])[0].tolist()


def test_keep_one_of_each_group(spark):
    rows = corpus(4, 50)
    copies = [(i, t) for i, t in rows[:5]] + [(rows[7][0], "another text under a known id " * 3), (None, rows[9][1])]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(df).collect()]
    sets = [words_of(t) for i, t in kept if i is not None]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert not (a and b and 100 * len(a & b) >= 80 * len(a | b))
    groups = {c for (i, n, c), _ in brute([x for x in rows + copies if x[0] is not None]).items() if n}
    assert len([s for s in sets if s]) >= len(groups) and (None, rows[9][1]) in kept
    assert ngram_join.keep_one(cases.empty(spark)).count() == 0 and set(ngram_join.keep_one(cases.documents(spark)).columns) == set(cases.documents(spark).columns)


def groups_of_rows(rows):
    """Row indices of each component of rows with words, by index and not by id."""
    sets, found = [words_of(t) for _, t in rows], []
    for k, a in enumerate(sets):
        near = [g for g in found if any(100 * len(a & sets[j]) >= 80 * len(a | sets[j]) for j in g)] if a else []
        found = [g for g in found if g not in near] + ([sum(near, [k])] if a else [])
    return found


@pytest.mark.parametrize("ids", ["few", "many"])
def test_keep_one_of_each_group_where_ids_repeat(spark, monkeypatch, ids):
    if ids == "many":
        monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", -1)
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (9, b + " end"), (9, a + " end"), (3, b + " x y z"), (5, "c d e f g h"), (7, ""), (7, None)]
    r = random.Random(6)
    rows += [(100 + r.randint(0, 14), t) for _, t in corpus(6, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((x["doc_id"], x["text"]) for x in ngram_join.keep_one(df).collect())
    worded = Counter({x: n for x, n in kept.items() if words_of(x[1])})
    for group in groups_of_rows(rows):
        here = {rows[k] for k in group}
        assert sum(n for x, n in worded.items() if x in here) == 1
        assert min(i for i, _ in here) in [i for i, _ in worded if (i, _) in here]
    assert kept - worded == Counter(x for x in rows if not words_of(x[1])) and sum(worded.values()) == len(groups_of_rows(rows))


def test_sets_that_link_share_a_key():
    """At the very threshold, for all small sizes and borders between schemes, whichever tokens differ."""
    rng, shared = np.random.default_rng(7), 0
    for size in [*range(1, 90), 100, 127, 128, 129, 160, 255, 256, 319, 320, 511, 512, 640, 1023, 1279, 1280, 3000]:
        for _ in range(6 if size > 200 else 12):
            base = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            least = (4 * size + 4) // 5
            both = int(rng.integers(least, size + 1))  # size of the intersection
            extra = int(rng.integers(0, max(0, 5 * both // 4 - size) + 1))
            if rng.random() < 0.7:  # as far apart as a link allows
                both, extra = (least, 0) if rng.random() < 0.5 else (size, 5 * size // 4 - size)
            kept = rng.permutation(base)[:both] if rng.random() < 0.5 else base[:both]
            other = np.unique(np.concatenate([kept, rng.integers(0, 1 << 64, extra, dtype=np.uint64)]))
            if 9 * len(kept) < 4 * (len(base) + len(other)):
                continue
            keys, owner = keys_of([base, other])
            assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size, (size, both, extra)
            shared += 1
    assert shared > 800
    a, b = (np.unique(rng.integers(0, 1 << 64, 400, dtype=np.uint64)) for _ in range(2))
    passage = np.unique(rng.integers(0, 1 << 64, 100, dtype=np.uint64))
    keys, owner = keys_of([np.union1d(a, passage), np.union1d(b, passage)])  # a fifth of each is shared
    assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size <= 3 and not (keys & np.uint64(1)).any()


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = []
    for _ in range(120):
        n = int(rng.integers(1, 900))
        at = int(rng.integers(0, 2000))
        own = base[at : at + n].copy()
        swap = rng.random(n) < rng.choice([0, 0.05, 0.1, 0.3])
        own[swap] = rng.integers(0, 1 << 63, int(swap.sum()), dtype=np.uint64)
        sets.append(np.unique(own))
    maps, sizes = [signature_tree.bitmap(s) for s in sets], [len(s) for s in sets]
    linked = {(i, j) for i in range(120) for j in range(i) if 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (sizes[i] + sizes[j])}
    found = {(max(p), min(p)) for p in signature_tree.candidates(maps, [0] * 120, sizes)}
    assert linked <= found and len(found) < 120 * 119 / 2
    sides = [k % 2 for k in range(120)]
    across = {(max(p), min(p)) for p in signature_tree.candidates(maps, sides, sizes)}
    assert {p for p in linked if sides[p[0]] != sides[p[1]]} <= across


def test_trees_prune_a_whole_table(monkeypatch):
    """All distinct sets of a table as one block: traversal over several levels leaves few pairs to compare bit by bit,
    and hardly more candidates than links."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    sets = [s for s in {s.tobytes(): s for s in shingle_sets([(t or "").encode() for t in texts])}.values() if len(s)]
    met, depth, plain = [], [], signature_tree._possible

    def possible(a, b):
        found = plain(a, b)
        met.append((found, bool(a.below or b.below), (a.last - a.first) * (b.last - b.first)))
        return found

    def built(self, *args, make=signature_tree.Tree.__init__):
        make(self, *args)
        node, levels = self.root, 1
        while node.below:
            node, levels = node.below[0], levels + 1
        depth.append(levels)

    monkeypatch.setattr(signature_tree, "_possible", possible)
    monkeypatch.setattr(signature_tree.Tree, "__init__", built)
    found = list(signature_tree.candidates([signature_tree.bitmap(s) for s in sets], [0] * len(sets), [len(s) for s in sets]))
    pairs = len(sets) * (len(sets) - 1) // 2
    compared = sum(n for ok, inner, n in met if ok and not inner)
    links = sum(9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b])) for a, b in found)
    assert max(depth) >= 3 and any(not ok for ok, _, _ in met) and compared < 0.35 * pairs and len(found) <= 20 * links + 50


@pytest.mark.parametrize("few", [components_module.FEW_EDGES, -1])
def test_components_against_union_find(spark, few, monkeypatch):
    monkeypatch.setattr(components_module, "FEW_EDGES", few)  # -1: hubs by broadcast
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(45)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, x, ids=None):
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def nearest(x, ids, q, qid, k):
    d = np.sqrt(((x - q) ** 2).sum(1))
    order = [j for j in np.lexsort((ids, d)) if ids[j] != qid]
    return [(int(ids[j]), float(d[j])) for j in order[:k]]


@pytest.mark.parametrize("shard", [hnsw.SHARD_ROWS, 200])
def test_recall_over_tables(spark, monkeypatch, shard):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", shard)  # 200: many shards to merge
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got = {}
    for r in hnsw.op3_hnsw(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == [i for i in sorted(ids) if i % 100 == 0]
    hit = 0
    for q, found in got.items():
        want = nearest(x, ids, x[list(ids).index(q)], q, 10)
        assert sorted(found) == list(range(1, 11)) and list(found.values()) is not None
        by_rank = [found[k] for k in range(1, 11)]
        assert by_rank == sorted(by_rank, key=lambda p: (p[1], p[0]))
        exact = dict(nearest(x, ids, x[list(ids).index(q)], q, len(ids)))
        assert all(abs(exact[v] - s) < 1e-12 for v, s in by_rank)
        hit += len({v for v, _ in want} & {v for v, _ in by_rank})
    assert hit / (10 * len(got)) >= 0.95


def test_recall_of_full_shards(spark):
    """Three shards near the production size, parameters as in production."""
    rng = np.random.default_rng(9)
    n = 20_500
    assert 2 < n / hnsw.SHARD_ROWS
    x = rng.normal(size=(60, 32))[rng.integers(0, 60, n)] + rng.normal(0, 0.5, size=(n, 32))
    x[::5] = rng.normal(size=(len(x[::5]), 32))
    df = vectors(spark, x)
    got = {}
    for r in hnsw.search(df, df.where("id % 100 = 0"), 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = sum(len(found & {v for v, _ in nearest(x, np.arange(n), x[q], q, 10)}) for q, found in got.items())
    assert len(got) == 205 and hit / 2050 >= 0.9


def test_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 4))
    x[20:120] = x[20]
    ids = rng.permutation(150)
    got = {}
    for r in hnsw.search(vectors(spark, x, ids), vectors(spark, x, ids).where("id % 10 = 0"), 10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q, found in got.items():
        assert [found[k] for k in range(1, 11)] == [v for v, _ in nearest(x, ids, x[list(ids).index(q)], q, 10)]


BAD = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]


def test_vector_cases(spark):
    rows = [(i, v, "x", 1.0) for i, v in [*BAD, (100, [1.0, 0.0]), (200, [0.0, 1.0]), (200, [0.0, 1.0]), (9, [1.0, 1.0])]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score double")
    use = _shards.usable(df, "vec_id", "embedding")
    assert Counter(r["id"] for r in use.collect()) == Counter([7, 100, 200, 200, 9])
    assert not hnsw.search(use, use.where("id = 7"), 10).collect()  # nothing else has its length
    got = sorted(map(tuple, hnsw.search(use, use.where("id = 100"), 10).collect()))
    assert [(g[1], g[2]) for g in got] == [(1, 9), (2, 200), (3, 200)]
    assert 3 in {r["id"] for r in _shards.usable(df, "vec_id", "embedding", zero=True).collect()}
    none = _shards.usable(df.limit(0), "vec_id", "embedding")
    assert hnsw.search(none, none, 10).count() == 0
    whole = use.withColumn("v", F.transform("v", lambda c: F.floor(c * 64.0).cast("double")))
    got = sorted(map(tuple, maxscore.search(whole, whole.where("id = 100"), 20).collect()))
    assert got == [(100, 1, 9, 4096), (100, 2, 200, 0), (100, 3, 200, 0)]
    assert maxscore.search(none, none, 20).count() == 0


@pytest.mark.parametrize("shard", [maxscore.SHARD_ROWS, 150])
def test_maxscore_matches_sql(spark, sf_dir, monkeypatch, shard):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", shard)
    assert differences(maxscore.op6_maxscore(spark, sf_dir), maxscore.SQL, sf_dir) == ""


def ranked(x, ids, row, k=20):
    s = x @ x[row]
    return [j for j in np.lexsort((ids, -s)) if j != row][:k], s


@pytest.mark.parametrize("kind", [np.int32, np.int64])
def test_postings_against_brute_force(kind):
    rng = np.random.default_rng(5)
    for n, dims, scale, zeros in [(1, 3, 5, 0), (7, 4, 2, 0), (400, 16, 40, 0), (300, 8, 1, 0), (900, 40, 30, 0.9), (500, 64, 9, 0.3)]:
        x = np.floor(rng.normal(0, scale, (n, dims))).astype(np.int64)
        x[rng.random((n, dims)) < zeros] = 0
        if n > 100:
            x[10:90] = x[10]
        ids = np.sort(rng.choice(10 * n, n, replace=False))
        p = maxscore.Postings(ids, x, kind)
        for row in range(0, n, max(1, n // 40)):
            places, scores = p.top(x[row], np.array([row]), 20)
            want, s = ranked(x, ids, row)
            assert places.tolist() == want and scores.tolist() == s[want].tolist()


def test_maxscore_splits_terms_and_probes():
    """On the table, as one shard with production settings, part of the terms is essential and postings are left unread."""
    rows = sorted((r["vec_id"], r["embedding"]) for r in pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist())
    x, ids = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64), np.array([i for i, _ in rows])
    p = maxscore.Postings(ids, x, maxscore.kind_for(x, x))
    queries = np.flatnonzero(ids % 20 == 0)
    for q in queries:
        places, _ = p.top(x[q], np.array([q]), 20)
        assert places.tolist() == ranked(x, ids, q)[0]
    whole = len(queries) * x.size
    assert 0.1 * whole < p.traversed < 0.5 * whole and p.probed > 0.1 * whole and p.traversed + p.probed < 0.95 * whole


def test_scores_beyond_doubles():
    x = np.array([[1 << 30, 1], [1 << 30, 2], [1 << 30, 3]], np.int64)
    places, scores = maxscore.Postings(np.array([5, 6, 7]), x).top(x[0], np.array([0]), 2)
    assert places.tolist() == [2, 1] and scores.tolist() == [(1 << 60) + 3, (1 << 60) + 2]
    assert maxscore.kind_for(x, x) is np.int64 and maxscore.kind_for(x % 7, x % 7) is np.int32
    with pytest.raises(OverflowError):
        maxscore.kind_for(x << 2, x << 2)


def test_every_operator_has_one_query():
    names = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert names == list(range(1, 11)) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)

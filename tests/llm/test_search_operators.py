"""Exact top-k, centroid clustering and the source audit against brute force and SQL, and on odd tables."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from comparing import compare

from lodestone.llm import centroids, divergence, queries, topk

VECTORS = "vec_id long, embedding array<float>, score string, cluster string, rank string, no string"


def vectors_of(rows):
    return [(i, v, "s", "c", "r", "n") for i, v in rows]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls, gaps, infinite parts, other lengths, ties, repeated rows and clashing names."""
    rnd = random.Random(3)
    some = [[rnd.choice((-0.5, -0.125, 0.0, 0.125, 0.25, 1.0)) for _ in range(6)] for _ in range(90)]
    rows = [(i, v) for i, v in enumerate(some)]
    rows += [(None, some[0]), (None, some[1]), (50, some[50]), (50, some[50]), (0, some[7]), (100, [0.0] * 6), (101, [0.0] * 6)]
    rows += [(150, None), (151, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (152, [math.nan] * 6), (200, [math.inf] * 6), (250, []), (251, []), (300, [1.0, 2.0]), (301, [0.5, -2.0]), (302, [0.5, -2.0])]
    return spark.createDataFrame(vectors_of(rows), VECTORS).repartition(5), rows


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top(rows, k, scale):
    held = [(n, i, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(rows) if finite(v)]
    out = []
    for n, i, q in held:
        if i is not None and i % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(q, v, strict=True)), -math.inf if j is None else j) for m, j, v in held if m != n and len(v) == len(q)]
            out += [(i, r, None if j == -math.inf else j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("block", "resolve", "questions"), [(4096, 128, 4096), (7, 2, 4096), (16, 1, 3)])
def test_top_k_matches_brute_force(odd_vectors, monkeypatch, block, resolve, questions):
    df, rows = odd_vectors
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "FIRST", min(block, 5))
    monkeypatch.setattr(topk, "RESOLVE", resolve)
    found = topk.exact_top_k(df.filter("vec_id % 50 = 0"), df, 5, 256, block=questions)
    assert Counter(map(tuple, found.collect())) == brute_top(rows, 5, 256)


def test_lists_find_the_best_without_reading_all():
    rng = np.random.default_rng(5)
    matrix = np.floor(256 * rng.normal(0, 0.125, (3000, 64))).astype(np.int64)
    asked = matrix[:40]
    orders = [np.lexsort((np.arange(3000), -(matrix @ q)))[:6] for q in asked]
    best = np.array([(matrix @ q)[o[-1]] for q, o in zip(asked, orders, strict=True)])
    for times in (1, 1000):  # sums beyond single precision
        lists, least = topk.Lists(np.arange(3000), matrix * times), best * times * times
        for floors in (np.full(40, -np.inf), least.astype(float)):
            found = {no: (ids, scores) for no, ids, scores in lists.best(asked * times, 6, floors)}
            assert sorted(found) == list(range(40))
            for no, (ids, scores) in found.items():
                assert (scores == lists.matrix[ids] @ asked[no] * times).all() and set(orders[no]) <= set(ids.tolist())
                assert len(ids) <= topk.RESOLVE  # reading went on until few could qualify


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame(vectors_of([(0, [1e30, 1.0]), (1, [1.0, 1.0])]), VECTORS)
    with pytest.raises(Exception, match="too large"):
        topk.exact_top_k(df.filter("vec_id = 0"), df, 5, 256).collect()
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(df, dims=2)


def brute_clusters(rows, clusters, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if finite(v) and len(v) == dims]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:clusters]
    middle = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        own = [[] for _ in middle]
        for _, v in kept:
            own[near(v)[1]].append(v)
        middle = [[sum(x) // len(vs) for x in zip(*vs, strict=True)] if vs else c for vs, c in zip(own, middle, strict=True)]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), middle


@pytest.mark.parametrize("clusters", [1, 4, 16, 200])
def test_clusters_match_brute_force(odd_vectors, clusters):
    df, rows = odd_vectors
    found, middle = centroids.cluster(df, clusters=clusters, dims=6)
    want, centres = brute_clusters(rows, clusters, 3, 6, 64, "1")
    assert Counter(map(tuple, found.collect())) == want and middle.tolist() == centres
    about = centroids.with_inertia(found, middle).collect()
    assert len(about) == sum(want.values()) and {r["inertia"] for r in about} == {sum(d * n for (_, _, d), n in want.items())}
    assert {(r["cluster"], r["centroid_sha256"]) for r in about} == {(c, hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for _, c, _ in want}


def test_tree_finds_ties_and_enters_few_nodes():
    rng = np.random.default_rng(6)
    for points in (rng.integers(-3, 4, (50, 2)), np.concatenate([rng.integers(-4, 5, (10, 8)) + 100 * rng.integers(0, 5, (1, 8)) for _ in range(10)]), np.zeros((20, 4), int)):
        asked = np.concatenate((points, rng.integers(-5, 6, (300, points.shape[1])), points[rng.integers(0, len(points), 200)] + 1))
        square = ((asked[:, None] - points[None]) ** 2).sum(2)
        who, best = centroids.Tree(points.astype(np.int64)).nearest(asked.astype(np.int64))
        assert (who == square.argmin(1)).all() and (best == square.min(1)).all()
    tree, looked = centroids.Tree(np.arange(0, 1000, 10).reshape(-1, 1)), Counter()

    class Counting(list):
        def __getitem__(self, v):
            looked[v] += 1
            return super().__getitem__(v)

    tree.points = Counting(tree.points)
    tree.nearest(np.array([[501]]))
    assert 0 < sum(looked.values()) < len(tree.points) / 2


def brute_audit(rows, fewest, smoothing, most):
    docs = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted((t for t, n in df.items() if n >= fewest), key=str.encode)
        counts = {s: Counter(t for _, x, ts in mine if x == s for t in ts if df[t] >= fewest) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())
        price = lambda c, t: 1 + 1_000_000_000 * (c[t] + smoothing) // (sum(c.values()) + smoothing * len(kept))  # noqa: E731, B023
        for s, c in counts.items():
            pairs = [(-sum(abs(price(c, t) - price(o, t)) for t in kept), x) for x, o in counts.items() if x != s]
            out += [(lang, s, "pair", x, -v, r) for r, (v, x) in enumerate(sorted(pairs, key=lambda p: (p[0], p[1].encode())), 1)]
            above = [(price(whole, t) - price(c, t), t) for t in kept if c[t] and price(c, t) > price(whole, t)]
            out += [(lang, s, "term", t, -v, r) for r, (v, t) in enumerate(sorted(above, key=lambda p: (p[0], p[1].encode()))[:most], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def odd_documents():
    rnd = random.Random(4)
    words = ["Straße", "É", "é", "ÄPFEL", "a", "B", "zz", "x-y", "don't", "日本語", "A1b", "w" * 3000, *(f"t{chr(97 + i)}" for i in range(20))]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))), rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "é", None, "S1"])) for _ in range(300)]
    rows += [(None, "en", "only nulls"), ("", "fr", "s1"), ("1 2 3 \x00\x7f", "fr", "s2"), ("alone", "it", "s1"), ("long " * 40_000 + "tail", "en", "s1")]
    return rows + rows[:10]


@pytest.mark.parametrize(("block", "segment", "part", "tile", "task"), [(1 << 20, 512, 1 << 20, 1 << 20, 500_000), (3000, 3, 50, 6, 7)])
def test_audit_matches_brute_force(spark, odd_documents, monkeypatch, block, segment, part, tile, task):
    """Small limits give many runs, segments, parts, tiles and salts."""
    monkeypatch.setattr(divergence, "SEGMENT_TERMS", segment)
    monkeypatch.setattr(divergence, "PART_BYTES", part)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TASK_ENTRIES", task)
    docs = spark.createDataFrame([(*r, "x", "y") for r in odd_documents], "text string, lang string, source string, term string, n string").repartition(3)
    monkeypatch.setattr(divergence, "LARGEST", task)  # beyond which products are wide
    for fewest, smoothing, most in ((5, 5, 4), (10_000, 5, 50)):
        found = divergence.audit(docs, fewest, smoothing, most, block_bytes=block)
        assert Counter(map(tuple, found.collect())) == brute_audit(odd_documents, fewest, smoothing, most)


def test_blocks_spill_and_runs_merge(spark):
    block = divergence.Block(4)
    for i in range(200):
        block.add(b"en", b"s%d" % (i % 3), b"word%c common " % (97 + i % 17) * 5)
    rows = list(divergence.rows_of(block.spill()))
    assert not block.bytes and [(s["shard"], s["lang"], s["first"]) for s in rows] == sorted((s["shard"], s["lang"], s["first"]) for s in rows)
    twice = sorted(rows + rows, key=lambda s: (s["shard"], s["lang"], s["first"]))
    found = {t: dict(zip(s, n.tolist(), strict=True)) for _, *table in divergence.merged(twice, 400) for t, s, n in zip(*table, strict=True)}
    assert found == {b"common": {b"s0": 670, b"s1": 670, b"s2": 660}, b"": {b"s0": 134, b"s1": 134, b"s2": 132}}


def test_a_long_text_is_counted_in_parts():
    text = b"Aa bb " * 2_000_000
    block = divergence.Block(1)
    tracemalloc.start()
    block.add(b"", b"", text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert block.counts[b""][b""] == {b"aa": 2_000_000, b"bb": 2_000_000, b"": 1} and peak < 80e6


def test_empty_tables(spark, none):
    empty = spark.createDataFrame([], VECTORS)
    assert topk.exact_top_k(empty, empty, 5, 256).count() == 0
    assert centroids.with_inertia(*centroids.cluster(empty)).count() == 0
    assert divergence.audit(none).count() == 0


@pytest.mark.parametrize("name", ["op11_exact_top_k", "op12_centroid_clustering", "op13_source_divergence"])
def test_queries_match_sql(spark, duck, data, name):
    compare(queries.QUERIES[name](spark, data), duck.sql(queries.ORACLE_SQL[name]))

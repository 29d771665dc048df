"""Text search against plain versions of it: every hit, no matter how rows, terms and slices fall."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import retrieve


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(text):
    return {p[i : i + 3] for w in words(text) for p in [f"  {w} "] for i in range(len(p) - 2)}


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = [(i, line(rnd.randint(0, 30)) + rnd.choice(["", "\n" + line(8)])) for i in range(120)] + [(500, None), (501, "")]
    asked = [(i, line(rnd.randint(1, 8))) for i in range(40)] + [(40 + i, texts[i][1].upper()) for i in range(8)] + [(48 + i, texts[i][1][3:19]) for i in range(8)] + [(90, ""), (91, None), (92, "zzz"), (None, "abc")]
    return spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string").repartition(3), asked, texts


def best(hits, k):
    out = set()
    for q in {h[0] for h in hits}:
        out |= {(q, d, s, r) for r, (s, d) in enumerate(sorted(((s, d) for x, d, s in hits if x == q), key=lambda p: (-p[0], p[1]))[:k], 1)}
    return out


def limits(monkeypatch, small):
    if small:
        monkeypatch.setattr(retrieve, "EXPANDED", 50)
        monkeypatch.setattr(retrieve, "SLICE", 7)
        monkeypatch.setattr(retrieve, "QUESTION_BLOCK", 9)
        monkeypatch.setattr(retrieve, "BLOCK_BYTES", 300)


@pytest.mark.parametrize("small", [False, True])
def test_trigram_search_finds_all(corpus, monkeypatch, small):
    limits(monkeypatch, small)
    questions, docs, asked, texts = corpus
    hits = []
    for q, t in asked:
        for d, x in texts:
            a, b = grams(t), grams(x)
            score = round(len(a & b) / max(len(a | b), 1), 6)
            if q is not None and (score > 0.3 or (t and x and t.lower() in x.lower() and a & b)):
                hits.append((q, d, score))
    found = {tuple(r) for r in retrieve.trigram_search(questions, docs, "doc_id", "text", 10).collect()}
    assert {(q, d, r) for q, d, _, r in found} == {(q, d, r) for q, d, _, r in best(hits, 10)} and len(found) > 150


@pytest.mark.parametrize("small", [False, True])
def test_full_text_finds_all(corpus, monkeypatch, small):
    limits(monkeypatch, small)
    questions, docs, asked, texts = corpus
    held = {t: sum(t in set(words(x)) for _, x in texts) for t in {w for _, q in asked for w in words(q)}}
    hits = []
    for q, t in asked:
        own = set(words(t))
        for d, x in texts:
            title = words((x or "").split("\n")[0])
            if q is not None and own and own <= set(words(x)):
                weight = {w: title.count(w) + 0.4 * (words(x).count(w) - title.count(w)) for w in own}
                total = sum(math.log(1 + (len(texts) - held[w] + 0.5) / (held[w] + 0.5)) * 2.2 * v / (v + 1.2) for w, v in weight.items())
                hits.append((q, d, round(min(total / 10, 1), 6)))
    found = {tuple(r) for r in retrieve.full_text(questions, docs, "doc_id", "text", 10).collect()}
    assert {(q, d, r) for q, d, _, r in found} == {(q, d, r) for q, d, _, r in best(hits, 10)} and len(found) > 30
    assert {(q, d): s for q, d, s, _ in found} == pytest.approx({(q, d): s for q, d, s, _ in best(hits, 10)}, abs=2e-6)


@pytest.mark.parametrize("small", [False, True])
def test_term_frequency_finds_all(corpus, monkeypatch, small):
    limits(monkeypatch, small)
    questions, docs, asked, texts = corpus
    hits = []
    for q, t in asked:
        for d, x in texts:
            score = sum(words(x).count(w) * len(w) for w in set(words(t)) if len(w) > 2)
            if q is not None and score:
                hits.append((q, d, round(min(score / 100, 1), 6)))
    found = {tuple(r) for r in retrieve.term_frequency_search(questions, docs, "doc_id", "text", 10).collect()}
    assert {(q, d, r) for q, d, _, r in found} == {(q, d, r) for q, d, _, r in best(hits, 10)}


def test_common_terms_cost_no_memory():
    """4,096 questions that share half of their terms with all rows."""
    rng = np.random.default_rng(10)
    common, names = [f"c{i}" for i in range(75)], [f"t{i}" for i in range(40_000)]
    index = retrieve.TermIndex([{"query_id": q, "terms": common + [names[i] for i in rng.choice(len(names), 75, replace=False)]} for q in range(4096)])
    rows = pa.array([common + [names[i] for i in rng.choice(len(names), 300, replace=False)] for _ in range(244)], pa.list_(pa.string()))
    rarest = index.rarest(index.sizes - 45 + 1, index.many)
    tracemalloc.start()
    row, term, _ = index.occurrences(rows)
    first = rarest.summed(len(rows), row, term, np.ones(len(row)))
    near = np.nonzero(first > 30)
    shared = index.shared(row, term, *near)
    whole = index.summed(len(rows), row, term, np.ones(len(row)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (whole >= 75).all() and (shared == whole[near]).all() and peak < 300e6


def test_articles_are_found_by_number_content_and_figures(spark):
    from pyspark.sql import functions as F

    texts = [(1, "Article 14.7 says", "14.7", "a"), (2, "as in 114.75 above", None, "a"), (3, "7 days, 14 hours", None, "b"), (4, "14 hours", None, "b"), (5, "see 14.7", "3.1", "a"), (6, "see 14.7", "3.1", "a"), (7, None, None, "c")]
    docs = spark.createDataFrame(texts, "d long, t string, article string, law string")
    numbers = spark.createDataFrame([("14.7",), ("99.9",)], "number string")
    found = retrieve.article_search(numbers, docs, F.col("article"), F.col("law"), F.col("t"), F.col("d"))
    assert sorted(map(tuple, found.collect())) == [("14.7", 1, 1.0, 1), ("14.7", 2, 0.6, 2), ("14.7", 3, 0.1, 4), ("14.7", 5, 0.6, 3)]  # 6 is a copy of 5
    assert {r["id"] for r in retrieve.article_search(numbers, docs, F.col("article"), F.col("law"), F.col("t"), F.col("d"), first=2).collect()} == {1, 2}


def test_focused_clauses_come_from_hit_documents(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 7), (2, 11, 1)], "query_id long, id long, rank int")
    pieces = spark.createDataFrame([(10, 0, "Wine and bread"), (10, 1, "water"), (11, 0, "wine"), (12, 0, "wine bread"), (13, 0, "wine")], "doc_id long, chunk_index long, text string")
    terms = spark.createDataFrame([(1, ["wine", "bread"]), (2, ["water"])], "query_id long, terms array<string>")
    found = retrieve.focused_clauses(hits, pieces, terms)
    assert sorted(map(tuple, found.collect())) == [(1, 10, 0, 0.88), (1, 11, 0, 0.8)]
    assert retrieve.focused_clauses(hits, pieces, terms, most=1).count() == 1

"""Exact vector search against a plain version of it, in bounded memory, however questions, items and ties fall."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieve


def plain(questions, items, k):
    out = set()
    for q, a in questions:
        scored = []
        for i, b in items:
            size = np.linalg.norm(a) * np.linalg.norm(b)
            scored.append((-round(min(max(float(np.dot(a, b) / size) if size else 0.0, 0), 1), 6), i))
        out |= {(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_vector_search_finds_all(spark, monkeypatch, small):
    """Vectors of small integers: most scores are shared by many items, and a third of them is 0."""
    if small:
        monkeypatch.setattr(retrieve, "EXPANDED", 40)
        monkeypatch.setattr(retrieve, "SLICE", 7)
        monkeypatch.setattr(retrieve, "QUESTION_BLOCK", 9)
    rnd = np.random.default_rng(5)
    items = [(int(i), [float(x) for x in rnd.integers(-1, 2, 4)]) for i in rnd.permutation(150)]
    questions = [(i, v) for i, v in items if i % 5 == 0]
    found = retrieve.vector_top_k(spark.createDataFrame(questions, "query_id long, vector array<double>"), spark.createDataFrame(items, "id long, vector array<double>").repartition(3), 12)
    assert {tuple(r) for r in found.collect()} == plain(questions, items, 12)
    few = retrieve.vector_top_k(spark.createDataFrame(questions[:3], "query_id long, vector array<double>"), spark.createDataFrame(items[:5], "id long, vector array<double>"), 12)
    assert {tuple(r) for r in few.collect()} == plain(questions[:3], items[:5], 12)


def test_rows_of_one_id_count_each(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0])], "id long, vector array<double>")
    found = retrieve.vector_top_k(items.filter("id = 2").withColumnRenamed("id", "query_id"), items, 3)
    assert sorted(tuple(r)[1:] for r in found.collect()) == [(1, 0.707107, 2), (1, 0.707107, 3), (2, 1.0, 1)]


class Items:
    """Stands for a table of items: keeps the function that tasks would run."""

    def __init__(self, spark):
        self.sparkSession, self.run = spark, None

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self.sparkSession.createDataFrame([], schema)


def test_vector_search_stays_within_its_memory(spark):
    """2,000 questions against full batches of 10,000 items: 160 MB as one matrix."""
    questions = spark.range(2000).select(F.col("id").alias("query_id"), F.array(*(F.sin(F.col("id") * n) for n in range(1, 9))).alias("vector"))
    items = Items(spark)
    retrieve.vector_top_k(questions, items, 20)
    vectors = np.random.default_rng(1).normal(size=(20_000, 8))
    batches = [pa.record_batch({"id": np.arange(at, at + 10_000), "vector": pa.array(list(vectors[at : at + 10_000]), pa.list_(pa.float64()))}) for at in (0, 10_000)]
    tracemalloc.start()
    rows = sum(batch.num_rows for batch in items.run(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 40_000 and peak < 120 << 20

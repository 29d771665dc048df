"""Pluggable models over tables, and an inverted-file index for vectors."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.retrieve import Best, question_blocks
from lodestone.operators.rows import top_k

Embedder = Callable[[list[str]], np.ndarray]


def feature_hashing(texts: list[str], dimensions: int = 64) -> np.ndarray:
    """Unit vectors of signed word counts: the default model, the same on every machine."""
    out = np.zeros((len(texts), dimensions))
    for row, text in zip(out, texts, strict=True):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            row[h % dimensions] += 1 if h >> 16 & 1 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(rows: DataFrame, key: str, text: str, model: Embedder = feature_hashing) -> DataFrame:
    """``key, vector``: ``model`` gets a batch of texts and gives a row for each; a count that differs is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            vectors = np.nan_to_num(model(texts), nan=0.0, posinf=0.0, neginf=0.0)
            if len(vectors) != len(texts):
                raise ValueError("the model gave another number of vectors than texts")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], names=[key, "vector"])

    return rows.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, vector array<double>")


def _matrix(vectors: pa.Array, n: int) -> np.ndarray:
    """Unit vectors of a batch as rows."""
    rows = np.array(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def cells_of(items: DataFrame, cells: int | None = None, sample: int = 20_000, seed: int = 7, most: int = 4096) -> np.ndarray:
    """Centres of clusters of unit vectors: as many as the square root of the items (16 to ``most``, which bounds what is broadcast), fitted on at most ``sample`` rows chosen by a hash of their id."""
    n = cells or min(most, max(16, math.isqrt(items.count())))
    norm = F.greatest(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-12))
    part = items.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector(F.transform("vector", lambda x: x.cast("double") / norm)).alias("features"))
    return np.array([c for c in KMeans(k=n, seed=seed, maxIter=10).fit(part).clusterCenters()])


def probes_for(items: DataFrame, centres: np.ndarray, k: int, recall: float = 0.97, sample: int = 4000, asked: int = 64) -> int:
    """Cells to probe so that, within a sample of items, ``recall`` of the k nearest of some of them lie in the probed cells; at most ``sample`` rows reach the driver."""
    part = items.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column("vector").combine_chunks()
    if not len(part):
        return 1
    rows, half = _matrix(part, len(part)), (centres**2).sum(1) / 2
    near = np.argsort(-(rows[:asked] @ rows.T), axis=1)[:, :k]
    cell = np.argmax(rows @ centres.T - half, axis=1)
    place = np.argsort(np.argsort(half - rows[:asked] @ centres.T, axis=1), axis=1)  # of each cell in the order of a question
    needed = np.take_along_axis(place, cell[near], 1) + 1
    return int(np.quantile(needed, recall, method="higher"))


def placed_in_cells(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """The index: ``id, vector, cell`` of every item, in tasks' own order by cell, so that batches hold few cells."""
    shared = items.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (shared.value**2).sum(1) / 2
        for batch in batches:
            rows = _matrix(batch.column(1), batch.num_rows) if batch.num_rows else np.zeros((0, shared.value.shape[1]))
            cell = np.argmax(rows @ shared.value.T - half, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64())), pa.array(cell, pa.int32())], names=["id", "vector", "cell"])

    return items.select(F.col("id").cast("long"), "vector").mapInArrow(place, "id long, vector array<double>, cell int").sortWithinPartitions("cell")


def indexed_top_k(questions: DataFrame, items: DataFrame, k: int, cells: int | None = None, probes: int | None = None, sample: int = 20_000) -> DataFrame:
    """``query_id, id, score, rank``: exact cosine among the items of the ``probes`` cells nearest to a question (by default as many as a sample needs); every item is in the index.

    Questions go in blocks to the index; each task passes on its best k, so no
    cell is a join key and none is hot.
    """
    centres = cells_of(items, cells, sample)
    near = min(len(centres), probes or probes_for(items, centres, k))
    index, half = placed_in_cells(items, centres), (centres**2).sum(1) / 2
    out = None
    for rows in question_blocks(questions, ["query_id", "vector"]):
        ids = np.array([r["query_id"] for r in rows], np.int64)
        asked = np.array([r["vector"] for r in rows], np.float64)
        asked /= np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-12)
        probed = np.zeros((len(ids), len(centres)), bool)
        np.put_along_axis(probed, np.argsort(half - asked @ centres.T, axis=1)[:, :near], True, 1)
        shared = items.sparkSession.sparkContext.broadcast((ids, asked, probed))

        def best(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asked, probed = shared.value
            found = Best(ids, k)
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                for c in np.unique(cell).tolist():
                    own, who = np.flatnonzero(cell == c), np.flatnonzero(probed[:, c])
                    if len(who):
                        scores = np.round(np.clip(asked[who] @ _matrix(batch.column("vector").take(pa.array(own)), len(own)).T, 0, 1), 6)
                        found.add(np.repeat(who, len(own)), np.tile(batch.column("id").to_numpy()[own], len(who)), scores.ravel())
            yield found.batch()

        part = index.mapInArrow(best, "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return questions.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    return top_k(out, ["query_id"], [F.desc("score"), F.col("id")], k)


def cross_encoder_blend(hits: DataFrame, question: str, text: str, scorer: Callable[[list[str], list[str]], np.ndarray], n: int = 10) -> DataFrame:
    """``query_id, id, score, model_failed, rank``: the first n hits rescored as 0.6 old + 0.4 model.

    A batch whose model fails, or gives another number of scores, keeps its old
    ones, and its rows say so in ``model_failed``, to be counted.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("score").to_numpy()
            try:
                new = np.clip(scorer(batch.column(question).to_pylist(), batch.column(text).to_pylist()), 0, 1)
                scores, failed = np.round(0.6 * old + 0.4 * new.reshape(old.shape), 6), False
            except Exception:  # noqa: BLE001  any failure of a plugged-in model
                scores, failed = old, True
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(scores), pa.array([failed] * len(old))], names=["query_id", "id", "score", "model_failed"])

    first = hits.filter(F.col("rank") <= n).select("query_id", "id", "score", question, text)
    blended = first.mapInArrow(run, "query_id long, id long, score double, model_failed boolean")
    rest = hits.filter(F.col("rank") > n).select("query_id", "id", "score", F.lit(False).alias("model_failed"))
    return top_k(blended.unionByName(rest), ["query_id"], [F.desc("score"), F.col("id")], 1 << 30)


def word_overlap(questions: list[str], texts: list[str]) -> np.ndarray:
    """Share of a question's words that the text holds: a stand-in for a cross-encoder."""
    shares = []
    for q, t in zip(questions, texts, strict=True):
        asked, held = set((q or "").lower().split()), set((t or "").lower().split())
        shares.append(len(asked & held) / max(len(asked), 1))
    return np.array(shares)

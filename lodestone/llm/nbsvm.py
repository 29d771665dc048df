"""Quality classifier: naive Bayes support vectors.

A text is a set of indicators: its byte 1- to 3-grams, and the limits that two
counters of recurrence reach, which are no n-grams: the longest run of word
pairs that stood in the text before (``ORDERS``), and how many words are
followed by themselves (``COUNTS``).  Indicators are scaled by
the log ratio of their smoothed shares in the two classes, and a linear
hinge-loss model is fitted to the scaled vectors by dual coordinate descent.  A
logistic curve fitted on a fold that the model did not see turns margins into
scores.

The model is fitted on at most ``sample`` labelled rows, chosen by a hash of
their id, and at most ``sample_bytes`` of their n-grams, in one task; its size is fixed.  Scoring reads every whole text and
shuffles nothing.

Edge cases: a null text is empty; an empty text is scored by the bias alone;
rows without a label are not learned from; if one class has no rows, every
score is the share of label 1 (0.5 without rows); a null id is never learned
from and is scored; repeated rows are scored each, and one row of an id is
learned from; an empty table gives no rows.  Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import small

#: Hashed n-gram space.
DIMS = 1 << 18
#: Counters: limits of the longest run of word pairs that stood in the text before, and of the number of words repeated at once; each limit reached is an indicator.
ORDERS, COUNTS = (1, 2, 4, 8, 16, 32, 64), (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)


class Featurizer:
    """Sorted n-gram indices of a text."""

    def __init__(self):
        self.seen = np.zeros(DIMS, bool)

    @staticmethod
    def recurrences(raw: bytes) -> list[int]:
        """Numbers of the limits that the two counters of recurrence reach."""
        words = raw.split()
        if len(words) < 2:
            return []
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        own = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        pairs = own[:-1] * len(ids) + own[1:]
        echoed = int((own[1:] == own[:-1]).sum())
        found = [len(ORDERS) + k for k, n in enumerate(COUNTS) if echoed >= n]
        _, first = np.unique(pairs, return_index=True)
        if len(first) == len(pairs):
            return found
        old = np.ones(len(pairs) + 2, np.int8)
        old[first + 1] = 0
        old[0] = old[-1] = 0
        edges = np.flatnonzero(np.diff(old))
        longest = int((edges[1::2] - edges[::2]).max())
        return found + [k for k, n in enumerate(ORDERS) if longest >= n]

    def __call__(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        grams = [b + 1]
        if len(b) > 1:
            grams.append(b[:-1] + (b[1:] << 8) + 0x10000)
        if len(b) > 2:
            three = (b[:-2] + (b[1:-1] << 8) + (b[2:] << 16)).astype(np.uint32) * np.uint32(2654435761)
            grams.append(0x20000 + (three >> 15))
        for g in grams:
            self.seen[g] = True
        for k in self.recurrences(raw):
            self.seen[512 + k] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.uint32)


@dataclass
class Model:
    """Weights over n-grams (ratios included), bias, and the logistic curve of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        n = len(found)
        margin = float(self.weights[found].sum()) / np.sqrt(n) + self.bias if n else self.bias
        z = self.slope * margin + self.shift
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, DIMS), smoothing)
    for found, label in zip(rows, labels, strict=True):
        counts[int(label), found] += 1
    return np.log(counts[1] / (smoothing + (labels == 1).sum())) - np.log(counts[0] / (smoothing + (labels == 0).sum()))


def dual_coordinate_descent(rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray, cost: float = 1.0, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights on the indicators (ratios folded in) and bias of the L2-regularised hinge loss; classes weigh the same."""
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, (labels == 1).mean(), (labels == 0).mean())
    upper = cost / (2 * share)
    scaled = [(ratios[f] / np.sqrt(max(len(f), 1))) for f in rows]
    norm = np.array([float(v @ v) + 1.0 for v in scaled])
    w, bias, alpha = np.zeros(DIMS), 0.0, np.zeros(len(rows))
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            f, v = rows[i], scaled[i]
            gradient = y[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[f] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratios, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the maximum-likelihood logistic curve, with smoothed targets."""
    positive, negative = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        weight = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margins).sum() + 1e-6 * slope, (p - target).sum()])
        h = np.array([[(weight * margins**2).sum() + 1e-6, (weight * margins).sum()], [(weight * margins).sum(), weight.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(shift)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Model:
    """Fit on the rows whose fold is not 0, the logistic curve on those whose fold is 0."""
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIMS), 0.0, 0.0, float(np.log(share / (1 - share))))
    inner = folds != 0
    if len(set(labels[inner].tolist())) < 2 or len(set(labels[~inner].tolist())) < 2:
        inner = np.ones(len(labels), bool)
    part = [f for f, k in zip(rows, inner, strict=True) if k]
    ratios = log_count_ratios(part, labels[inner])
    weights, bias = dual_coordinate_descent(part, ratios, labels[inner])
    model = Model(weights, bias, 1.0, 0.0)
    outer = ~inner if (~inner).any() else inner
    margins = np.array([float(weights[f].sum()) / np.sqrt(max(len(f), 1)) + bias for f, k in zip(rows, outer, strict=True) if k])
    model.slope, model.shift = logistic_curve(margins, labels[outer])
    return model


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def chosen(docs: DataFrame, labels: DataFrame, sample: int = 12_000, sample_bytes: int = 256 << 20, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``id, label, found``: the n-grams of the rows to learn from, outside the held-out fold (``fold`` 0)."""
    key = F.col(doc_id)
    known = labels.filter(key.isNotNull() & F.col(label).isin(0, 1) & (fold(key) != 0)).select(key.cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    # bounded by ``sample`` rows of 12 bytes, so it fits to broadcast
    some = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = docs.select(key.cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(some), "id")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer()
        for batch in small(batches):
            found = [make(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(found, pa.binary())], names=["id", "label", "found"])

    found = rows.select("id", "label", "text").mapInArrow(features, "id long, label int, found binary")
    # rows that share an id would multiply in the join: one of them is kept, so ``sample`` bounds the rows of the task that trains
    single = found.groupBy("id").agg(F.min(F.struct("label", "found")).alias("row")).select("id", "row.label", "row.found")
    upto = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = single.withColumn("bytes", F.sum(F.octet_length("found").cast("long")).over(upto))
    return held.filter(F.col("bytes") <= sample_bytes).select("id", "label", "found")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, sample_bytes: int = 256 << 20, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on at most ``sample`` rows of ``labels`` outside the held-out fold, as long as their n-grams fill at most ``sample_bytes``."""

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("label", "ascending")])
        rows = [np.frombuffer(x, np.uint32) for x in table.column("found").to_pylist()]
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        model = fit_rows(rows, labels, (mixed % np.uint64(5)).astype(np.int64))
        blob = model.weights.astype("<f4").tobytes()
        return pa.table({"weights": pa.array([blob], pa.binary()), "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]})

    rows = chosen(docs, labels, sample, sample_bytes, doc_id, text, label).withColumn("all", F.lit(0))
    fitted = rows.groupBy("all").applyInArrow(train, "weights binary, bias double, slope double, shift double").first()
    if fitted is None:
        return fit_rows([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Model(np.frombuffer(fitted["weights"], "<f4"), fitted["bias"], fitted["slope"], fitted["shift"])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every document; the model is ``4 * DIMS`` bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias, model.slope, model.shift))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, model = Featurizer(), shared.value
        for batch in small(batches):
            scores = [model.score(make(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")

"""Exact top-k by inner product, with no-random-access aggregation over sorted lists.

Vectors become integers, ``floor(scale * x)``.  A task cuts its items into
blocks and sorts each dimension of a block once, into a list for either sign of
a question's component.  The lists are read side by side, for all questions of
a group at once.  An item's score is at least what was read of it plus the
least product of every list that it was not met in, and at most that plus the
product read last there.  Items never met are bounded by the products read last.
Reading stops when no more than ``RESOLVE`` items can reach the k-th best
score: the k-th of the lower bounds, or of the final scores of earlier blocks.
Their scores are then resolved, as exact integers.

Questions go to the tasks in blocks of a fixed size.  A task passes on k rows
for each question, so no vectors are shuffled, and a result does not depend on
how items are dealt.

Edge cases: vectors that are null or hold a null, NaN or infinite component
take no part; only vectors of equal length meet, and empty ones score 0; a null
id is the smallest id and comes back as null; of rows that repeat each is a
candidate and, if its id asks, a question of its own, whose own row is left out
once; fewer items than k are all returned; components so large that a score
passes 2 ** 53 raise an error; other columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import small
from lodestone.llm.store import new_path

#: Items of a task's first block and of its largest; blocks double, as later ones start with a better floor.
FIRST, BLOCK = 256, 4096
#: Items left open at which reading stops; questions that read a block together.
RESOLVE, TOGETHER = 256, 512
#: How far lists have been read at each look at the bounds.
STOPS = np.array([0.25, 0.5, 0.625, 0.75, 0.875, 1])
#: Questions that one pass over the items answers.
QUESTIONS = 4096
#: Stands for a null id in a task.
NO_ID = -(1 << 63)
EXACT = 1 << 53


def finite(vector: Column) -> Column:
    """Whether a vector is there, without null, NaN or infinite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


class Lists:
    """A block of items of equal length; each dimension as a list from the largest value down, and one from the smallest up."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        up = np.argsort(matrix, axis=0, kind="stable").T
        self.item = np.concatenate((up[:, ::-1], up))
        self.value = np.take_along_axis(np.concatenate((matrix.T, matrix.T)), self.item, 1)

    def best(self, asked: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``question, ids, scores`` for each row of ``asked``: items that hold the k best of this block that reach its floor, and few others.

        All questions share the reading: a step goes on in all lists, and a
        question takes of each dimension the list whose products begin high.
        """
        n, dims = self.matrix.shape
        small_sums = dims * int(np.abs(self.matrix).max(initial=0)) * int(np.abs(asked).max(initial=0)) < 1 << 24
        kind = np.float32 if small_sums else np.float64  # in which sums of integers are exact
        weights = np.concatenate((np.maximum(asked, 0), np.minimum(asked, 0)), 1).astype(kind)
        value, lists = self.value.astype(kind), np.arange(2 * dims)[:, None]
        read, unread = np.zeros((2 * dims, n), kind), np.ones((2 * dims, n), kind)
        floors, going, depth = floors.copy(), np.arange(len(asked)), 0
        for stop in np.unique(np.ceil(n * STOPS).astype(int)):
            entries = self.item[:, depth:stop]
            read[lists, entries], unread[lists, entries] = value[:, depth:stop], 0
            depth = stop
            own = weights[going]
            known = own @ read
            upper = known + (own * value[:, stop - 1]) @ unread
            if n >= k:
                lower = known + (own * value[:, -1]) @ unread
                floors[going] = np.maximum(floors[going], np.partition(lower, n - k, axis=1)[:, n - k])
            open_ = upper >= floors[going, None]
            ends = (np.count_nonzero(open_, axis=1) <= RESOLVE) | (stop == n)
            for at in np.flatnonzero(ends):
                rows = np.flatnonzero(open_[at])
                yield int(going[at]), self.ids[rows], self.matrix[rows] @ asked[going[at]]
            going = going[~ends]
            if not len(going):
                return


class Top:
    """The k best of one question so far: highest scores, ties to smaller ids."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def by_length(ids: np.ndarray, vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``places, matrix`` of integers for each length of vector."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        at = (ends[places] - size)[:, None] + np.arange(size)
        matrix = values[at]
        if size and np.abs(matrix).max(initial=0) >= 1 << 31:
            raise ValueError("components are too large for exact scores")
        yield places, matrix.astype(np.int64)


def growing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, from ``FIRST`` rows to ``BLOCK``."""
    rows = FIRST
    for batch in small(batches, 1 << 30):
        at = 0
        while at < batch.num_rows:
            yield batch.slice(at, rows)
            at += rows
            rows = min(2 * rows, BLOCK)


def _block(questions: DataFrame, n: int, no: int, scale: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """``ids`` of a block of questions, and ``places, matrix`` of them by length."""
    found = questions.filter(F.pmod(F.xxhash64("id", "vector"), F.lit(n)) == no).toArrow()
    ids = found.column("id").to_numpy()
    vectors = found.column("vector").combine_chunks()
    return ids, {m.shape[1]: (places, m) for places, m in by_length(ids, vectors, scale)}


def exact_top_k(questions: DataFrame, items: DataFrame, k: int, scale: int, item_id: str = "vec_id", vector: str = "embedding", block: int = QUESTIONS) -> DataFrame:
    """``query_id, rank, <item_id>, score``: the k best items of each question, every row but its own.

    Both tables hold ``item_id`` and ``vector``.  A block's result is written
    to the shared folder before the next one begins.
    """
    spark = items.sparkSession
    rows = [t.filter(finite(F.col(vector))).select(F.coalesce(F.col(item_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(vector).alias("vector")) for t in (questions, items)]
    asked, held = rows
    path, schema = new_path(spark, "top-k"), f"query_id long, rank int, {item_id} long, score long"
    blocks = max(1, -(-asked.count() // block))
    for no in range(blocks):
        shared = spark.sparkContext.broadcast(_block(asked, blocks, no, scale))

        def best(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, by_size = shared.value
            tops = [Top(k + 1) for _ in ids]  # with the question's own row
            for batch in growing(batches):
                own = batch.column(0).to_numpy()
                for places, matrix in by_length(own, batch.column(1), scale):
                    wanted, vectors = by_size.get(matrix.shape[1], ((), None))
                    if not len(wanted):
                        continue
                    if matrix.shape[1] * int(np.abs(matrix).max(initial=0)) * int(np.abs(vectors).max(initial=0)) >= EXACT:
                        raise ValueError("components are too large for exact scores")
                    lists = Lists(own[places], matrix)
                    for at in range(0, len(wanted), TOGETHER):
                        some = wanted[at : at + TOGETHER]
                        floors = np.array([tops[q].floor for q in some])
                        for no, found, scores in lists.best(vectors[at : at + TOGETHER], k + 1, floors):
                            tops[some[no]].add(found, scores)
            self_scores = np.zeros(len(ids), np.int64)
            for wanted, vectors in by_size.values():
                self_scores[wanted] = (vectors * vectors).sum(1)
            sizes = [len(t.ids) for t in tops]
            no = np.repeat(np.arange(len(ids)), sizes)
            columns = (no, ids[no], np.concatenate([t.ids for t in tops]) if sizes else no, np.concatenate([t.scores for t in tops]) if sizes else no, self_scores[no])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["no", "query_id", "id", "score", "own"])

        found = held.mapInArrow(best, "no long, query_id long, id long, score long, own long")
        best_first = Window.partitionBy("no").orderBy(F.desc("score"), "id")
        first = found.withColumn("place", F.row_number().over(best_first)).filter(F.col("place") <= k + 1)
        itself = F.when((F.col("id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))
        left_out = first.withColumn("left_out", F.coalesce(F.min(itself).over(Window.partitionBy("no")), F.lit(k + 1)))
        others = left_out.filter("place <> left_out").withColumn("rank", F.col("place") - (F.col("place") > F.col("left_out")).cast("int"))
        real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
        others.select(real("query_id").alias("query_id"), "rank", real("id").alias(item_id), "score").write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(schema).parquet(path)

"""Centroid clustering of integer vectors, with a vantage-point tree over the centroids.

The driver holds the centroids only: ``clusters`` vectors.  Each round it builds
a vantage-point tree over them and broadcasts it; every vector looks for its
nearest centroid best-first: of its open nodes it enters that with the smallest
lower bound, as long as the bound does not exceed the distance of the best
centroid so far.  A bound that equals it is entered as well, and bounds are
lowered by more than rounding can cost, so that no tie is lost; distances at
vantage points and leaves are exact integers, and ties go to the smaller
number.  Tasks sum their vectors by centroid; a sum for each task, centroid and
dimension is all that is shuffled.

Edge cases: vectors that are null, of another length, or hold a null, NaN or
infinite component are left out; a null id is kept, and hashes like an empty one;
repeated rows count each, and equal ids begin in the order of their vectors;
with fewer vectors than ``clusters`` there are fewer centroids; a centroid
without vectors stays where it is; components of 2 ** 26 or more after scaling
raise an error, since distances might not fit; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import small
from lodestone.llm.store import stored
from lodestone.llm.topk import finite

#: Centroids of a leaf; largest component whose distances fit.
LEAF, LARGEST = 3, 1 << 26
#: What rounding of roots may cost a bound, absolute and relative.
SLACK, RELATIVE = 1e-6, 1e-12


class Tree:
    """Vantage-point tree: a node's points (its vantage point, or a leaf's centroids) and its children with the range of their distances from the vantage point."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.points: list[list[int]] = []
        self.children: list[list[tuple[int, float, float]]] = []
        if len(centroids):
            self._grow(list(range(len(centroids))))

    def _grow(self, members: list[int]) -> int:
        node = len(self.points)
        self.children.append([])
        if len(members) <= LEAF:
            self.points.append(members)
            return node
        square = lambda i: ((self.centroids[members] - self.centroids[i]) ** 2).sum(1)
        # the member with the widest spread of distances parts the others best
        vantage = max(members, key=lambda i: (float(np.std(np.sqrt(square(i)))), -i))
        self.points.append([vantage])
        away = dict(zip(members, np.sqrt(square(vantage)).tolist(), strict=True))
        rest = sorted((m for m in members if m != vantage), key=lambda m: (away[m], m))
        for part in (rest[: len(rest) // 2], rest[len(rest) // 2 :]):
            if part:
                child = self._grow(part)
                self.children[node].append((child, away[part[0]], away[part[-1]]))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``numbers, distances``: for each vector its nearest centroid and the squared distance."""
        n = len(vectors)
        best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.centroids))
        bound = np.full((n, len(self.points)), np.inf)
        bound[:, 0] = 0
        rows = np.arange(n)
        while len(rows):
            node = bound[rows].argmin(1)
            low = bound[rows, node]
            near = low <= np.sqrt(best[rows].astype(np.float64)) * (1 + RELATIVE) + SLACK
            rows, node, low = rows[near], node[near], low[near]
            bound[rows, node] = np.inf
            for v in np.unique(node):
                mine = node == v
                own = rows[mine]
                for p in self.points[v]:
                    square = ((vectors[own] - self.centroids[p]) ** 2).sum(1)
                    closer = (square < best[own]) | ((square == best[own]) & (p < who[own]))
                    best[own[closer]], who[own[closer]] = square[closer], p
                if self.children[v]:
                    away = np.sqrt(square.astype(np.float64))
                    for child, least, most in self.children[v]:
                        gap = np.maximum(away - most, least - away) * (1 - RELATIVE) - SLACK
                        bound[own, child] = np.maximum(gap, low[mine])
        return who, best


def integers(table: DataFrame, dims: int, scale: int, item_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``<item_id>, cells``: the kept vectors as integers ``floor(scale * x)``."""
    v = F.col(vector)
    cells = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    return table.filter(finite(v) & (F.size(v) == dims)).select(F.col(item_id).cast("long").alias(item_id), cells.alias("cells"))


def first_centroids(kept: DataFrame, clusters: int, seed: str, item_id: str = "vec_id") -> np.ndarray:
    """The vectors with the smallest SHA-256 of ``<seed>:<id>``, in order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(item_id).cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "cells").orderBy("key", "cells").limit(clusters).collect()
    return np.array([r["cells"] for r in rows], np.int64)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    cells = batch.column("cells").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
    if cells.size and (cells.max() >= LARGEST or cells.min() <= -LARGEST):
        raise ValueError("components are too large for exact distances")
    return cells


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: the floor of the mean of their vectors, exactly."""
    tree = kept.sparkSession.sparkContext.broadcast(Tree(centroids))
    k, dims = centroids.shape

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in small(batches, 4096):
            vectors = _matrix(batch)
            who, _ = tree.value.nearest(vectors)
            np.add.at(total, who, vectors)
            n += np.bincount(who, minlength=k)
        number, place = np.divmod(np.arange(k * dims), max(dims, 1))
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(place), pa.array(total.ravel()), pa.array(n[number])], names=["cluster", "place", "total", "n"])

    parts = kept.select("cells").mapInArrow(sums, "cluster long, place long, total long, n long")
    whole = parts.groupBy("cluster", "place").agg(*(F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in ("total", "n")))
    out = centroids.copy()
    for r in whole.filter("n > 0").collect():  # clusters x dims rows at most
        out[r["cluster"], r["place"]] = int(r["total"]) // int(r["n"])
    tree.unpersist()
    return out


def assigned(kept: DataFrame, centroids: np.ndarray, item_id: str = "vec_id") -> DataFrame:
    """``<item_id>, cluster, distance``: the nearest centroid of each vector and the squared distance."""
    tree = kept.sparkSession.sparkContext.broadcast(Tree(centroids))

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            who, distance = tree.value.nearest(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(distance)], names=[item_id, "cluster", "distance"])

    return kept.select(item_id, "cells").mapInArrow(nearest, f"{item_id} long, cluster int, distance long")


def cluster(table: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", item_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``<item_id>, cluster, distance`` for each kept vector after ``rounds``, and the centroids."""
    kept = stored(integers(table, dims, scale, item_id, vector), "cells")
    centroids = first_centroids(kept, clusters, seed, item_id)
    if len(centroids):
        for _ in range(rounds):
            centroids = moved(kept, centroids)
        return stored(assigned(kept, centroids, item_id), "assigned"), centroids
    return kept.select(item_id, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds ``cluster_inertia, inertia, centroid_sha256`` to the rows of ``cluster``; a row for each centroid is joined."""
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    rows = [(i, sums.get(i, 0), total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    about = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster")

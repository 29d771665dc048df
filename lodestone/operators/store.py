"""Stored tables that are changed in place: upserts that rewrite only what they touch, and deletes that follow foreign keys.

A stored table is a folder with a partition for each bucket of its keys.  An
upsert reads the buckets that its rows fall into and replaces these alone
(dynamic partition overwrite), so its cost follows the change, not the table:
the files of other buckets stay as they are.  New buckets are first written
aside, so that nothing is read from what is being replaced; a run that is lost
before it ends can be repeated with the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import stable_uuid
from lodestone.operators.rows import replace_children, upsert
from lodestone.shared import remove, scratch

BUCKET = "bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Store:
    """A table at ``path`` in ``buckets`` by ``keys``; ``schema`` names its columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, bucket_of(self.keys, self.buckets))

    def create(self, rows: DataFrame) -> None:
        self._dealt(rows).repartition(BUCKET).write.partitionBy(BUCKET).parquet(self.path)

    def read(self, touched: Sequence[int] | None = None) -> DataFrame:
        """The rows, of the buckets ``touched`` if given; others are not listed for reading."""
        rows = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)
        return (rows if touched is None else rows.filter(F.col(BUCKET).isin(*touched))).drop(BUCKET)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into: ``buckets`` numbers at most."""
        return sorted(r[0] for r in self._dealt(rows).select(BUCKET).distinct().collect())

    def replace(self, rows: DataFrame, touched: Sequence[int]) -> None:
        """Put ``rows`` in place of the buckets ``touched``; those that get none go."""
        aside = scratch(self.spark)
        self._dealt(rows).repartition(BUCKET).write.partitionBy(BUCKET).parquet(aside)
        new = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(aside)
        filled = {r[0] for r in new.select(BUCKET).distinct().collect()}
        new.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        remove(self.spark, [f"{self.path}/{BUCKET}={b}" for b in touched if b not in filled] + [aside])

    def upsert(self, delta: DataFrame, keep: Sequence[str] = ()) -> list[int]:
        """Rows of ``delta`` in place of those with equal keys, which keep the columns ``keep``; gives the buckets rewritten."""
        touched = self.touched(delta)
        if touched:
            self.replace(upsert(self.read(touched), delta, self.keys, keep), touched)
        return touched

    def replace_children(self, parents: DataFrame, children: DataFrame) -> list[int]:
        """``children`` in place of all rows of ``parents``, whose keys are this table's keys."""
        touched = self.touched(parents)
        if touched:
            self.replace(replace_children(self.read(touched), parents, children, self.keys), touched)
        return touched


def upsert_documents(documents: Store, chunks: Store, delta: DataFrame, pieces: DataFrame) -> None:
    """Documents by (source, source_id) and the chunks of each: a known document keeps its stored ``id``, a new one gets that of its keys; all its chunks are replaced.

    ``delta`` has the documents' columns but ``id``; ``pieces`` (source,
    source_id, ...) the chunks of all of them.
    """
    keys = documents.keys
    documents.upsert(delta.withColumn("id", stable_uuid(F.concat_ws("\x1f", *keys))), keep=["id"])
    chunks.replace_children(delta.select(*keys), pieces)


Link = tuple[str, Sequence[str], str, Sequence[str]]


def cascade(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], links: Sequence[Link], doomed: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The keys of all rows that go with ``doomed``, for each table that loses some.

    ``tables`` are (rows, key columns); a link (child, columns, parent, columns)
    says that the child's columns refer to the parent's.  Keys pass from level
    to level, and a table is met once all tables above it have been, so one that
    hangs on two parents is scanned for both together.  Only keys and foreign
    keys are read and shuffled.  Null foreign keys refer to nothing; links that
    form a ring are refused.
    """
    found = {name: rows.select(*tables[name][1]).distinct() for name, rows in doomed.items()}
    open_, waiting = list(links), {child for child, *_ in links}
    done = [name for name in tables if name not in waiting]
    while waiting:
        ready = [name for name in sorted(waiting) if all(parent in done for child, _, parent, _ in open_ if child == name)]
        if not ready:
            raise ValueError(f"foreign keys form a ring: {sorted(waiting)}")
        for name in ready:
            rows, keys = tables[name]
            parts = [found[name]] if name in found else []
            for child, columns, parent, referred in open_:
                if child == name and parent in found:
                    # the parent's key columns are known of its doomed rows; other columns that are referred to are looked up
                    gone = found[parent]
                    if not set(referred) <= set(gone.columns):
                        own, own_keys = tables[parent]
                        gone = own.select(*{*own_keys, *referred}).join(gone, list(own_keys), "left_semi")
                    named = gone.select(*(F.col(r).alias(c) for r, c in zip(referred, columns, strict=True))).distinct()
                    parts.append(rows.select(*dict.fromkeys([*keys, *columns])).join(named, list(columns), "left_semi").select(*keys))
            if parts:
                whole = parts[0]
                for part in parts[1:]:
                    whole = whole.unionByName(part)
                found[name] = whole.distinct()
        done += ready
        waiting -= set(ready)
    return found


def surviving(rows: DataFrame, keys: Sequence[str], gone: DataFrame | None) -> DataFrame:
    """Rows whose keys are not among ``gone``."""
    return rows if gone is None else rows.join(gone, list(keys), "left_anti")

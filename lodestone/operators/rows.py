"""Row operators shared by many queries: top-k, first and best per key, upsert, keep-unless-empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Rank of each row within its keys, from 1; ``order`` must break ties."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; the filter on the rank lets Spark drop rows before the shuffle (window group limit)."""
    return ranked(df, keys, order, rank).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "__first").drop("__first")


def best_by_key(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """One row per key, that with the highest score (ties: the greatest remaining columns); combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != score]
    best = df.groupBy(*keys).agg(F.max(F.struct(score, *rest)).alias("__best"))
    return best.select(*keys, *(F.col(f"__best.{c}").alias(c) for c in df.columns if c not in keys)).select(*df.columns)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those with equal keys; columns in ``keep`` hold their old value if there is one."""
    kept = base.join(delta.select(*keys), list(keys), "left_anti")
    if keep:
        old = base.select(*keys, *(F.col(c).alias(f"__old_{c}") for c in keep))
        delta = delta.join(old, list(keys), "left").select(
            *(F.coalesce(F.col(f"__old_{c}"), F.col(c)).alias(c) if c in keep else F.col(c) for c in delta.columns)
        )
    return kept.unionByName(delta.select(*base.columns))


def replace_children(children: DataFrame, delta: DataFrame, new_children: DataFrame, parent: str | list[str]) -> DataFrame:
    """Children of parents in ``delta`` give way to ``new_children``."""
    keys = [parent] if isinstance(parent, str) else parent
    return children.join(delta.select(*keys), keys, "left_anti").unionByName(new_children.select(*children.columns))


def keep_unless_empty(df: DataFrame, keys: Sequence[str], passes: Column) -> DataFrame:
    """Rows that pass; all rows of a key of which none passes."""
    any_ = F.max(passes.cast("int")).over(Window.partitionBy(*keys)) == 1
    return df.withColumn("__pass", passes).withColumn("__any", any_).filter(F.col("__pass") | ~F.col("__any")).drop("__pass", "__any")

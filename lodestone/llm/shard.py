"""Sharding by jump consistent hashing, in built-in expressions only.

A key walks through the shard numbers at which it would move if shards were
appended one by one; the last number below the shard count is its shard.  The
pseudo-random stream of a key depends on the key and the step alone, so going
from n to n + 1 shards moves about 1 / (n + 1) of the keys, all into the new
shard, and no ring table is kept.

Edge cases: a null key is a key like any other (all null keys share a shard);
a null text counts as empty; rows that repeat get slots of their own; an
empty table gives an empty result.  Columns other than the named ones are
carried by ``assign_shards`` (a column of the output's name is replaced) and
not read by ``shard_index``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps after which a walk must have ended.  A walk to n shards takes ln(n) + 0.6 steps on average;
#: 160 or more steps have a chance below 1e-60 for any 32-bit shard count, and end in an error, not a wrong shard.
MAX_STEPS = 160
#: Added to each row's bytes: the record header of the shard files.
ROW_OVERHEAD = 16


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of ``key`` among ``shards`` (int column)."""
    if not 1 <= shards <= 2**31 - 1:
        raise ValueError("shards must be between 1 and 2^31 - 1")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))

    def step(state: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, i), 33) + F.lit(1)
        leap = F.floor((state["next"] + F.lit(1)) * F.lit(2147483648.0) / draw).cast("long")
        return F.when(
            state["next"] < F.lit(shards),
            F.struct(state["next"].alias("at"), F.greatest(leap, state["next"] + F.lit(1)).alias("next")),
        ).otherwise(state)

    def finish(state: Column) -> Column:
        return F.when(state["next"] >= F.lit(shards), state["at"]).otherwise(
            F.raise_error(F.lit("jump hash walk did not end")).cast("long")
        )

    steps = F.sequence(F.lit(1), F.lit(min(shards, MAX_STEPS)))
    return F.aggregate(steps, start, step, finish).cast("int")


def assign_shards(df: DataFrame, key: str, shards: int, column: str = "shard") -> DataFrame:
    """``df`` with the shard of each row in ``column``; no shuffle."""
    return df.withColumn(column, jump_shard(F.col(key), shards))


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Write ``df`` as one folder ``shard=<n>`` per shard; each task keeps one file open at a time."""
    assign_shards(df, key, shards).sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)


def shard_index(docs: DataFrame, key: str, text: str, shards: int, buckets: int = 64) -> DataFrame:
    """Directory of the shards: ``key, size, text_crc32, shard, slot, grown_shard``.

    ``slot`` numbers the rows of a shard from 0 without gaps.  Equal rows are
    counted before anything is sorted, so that a key or text of a third of all
    rows is one row to number.  A shard is dealt into ``buckets`` by a hash of
    key and text, each numbered by its own task and shifted by the rows in the
    buckets before it, so no task holds a whole shard.  The table of shifts has
    ``shards * buckets`` rows at most, whatever the input, which is what makes
    it fit to broadcast.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(content) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    equal = rows.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "shard": jump_shard(F.col("key"), shards),
        "grown_shard": jump_shard(F.col("key"), shards + 1),
        "bucket": F.pmod(F.xxhash64(F.lit("slot"), "key", "size", "text_crc32"), F.lit(buckets)).cast("int"),
    })
    filled = equal.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = filled.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = equal.withColumn("place", F.coalesce(F.sum("n").over(within), F.lit(0)))
    first = numbered.join(F.broadcast(shifts), ["shard", "bucket"]).withColumn("first", F.col("shift") + F.col("place"))
    step = F.lit(10_000).cast("long")  # equal rows come back in short arrays
    parts = first.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)))
    spread = parts.withColumn("i", F.explode(F.sequence("at", F.least(F.col("at") + step, F.col("n")) - 1)))
    return spread.select("key", "size", "text_crc32", "shard", (F.col("first") + F.col("i")).alias("slot"), "grown_shard")

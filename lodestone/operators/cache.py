"""A cache of answers whose entries expire: lookups as of a moment, hit counts, and the state after upserts.

Entries and lookups carry their times, so a log of both is answered in one job:
a lookup sees the entry that was newest at its time, by a running value over
the union of both in order of time, not by an inequality join.  A key's time is
cut into spans, within which rows are ordered; only one row a span crosses it,
so a key that holds a third of all rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a span.
SPAN = 6 * 3600


def _span(time: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000))


def as_of(asked: DataFrame, facts: DataFrame, keys: Sequence[str], time: str, since: str, fact: str, seconds: int = SPAN) -> DataFrame:
    """``asked`` with ``fact``: the columns of ``facts`` besides the keys, of the row that was newest by ``since`` at ``time`` (itself included); null if there was none.

    Of facts of one moment the greatest counts.  Null keys meet nothing.
    """
    rest = [c for c in facts.columns if c not in keys and c != since]
    value = F.struct(since, *rest)
    probes = asked.withColumns({"__at": F.col(time), "__fact": F.lit(None).cast(facts.select(value.alias("v")).schema["v"].dataType)})
    known = facts.select(*keys, F.col(since).alias("__at"), value.alias("__fact"))
    both = probes.unionByName(known, allowMissingColumns=True).withColumn("__span", _span("__at", seconds))
    # nulls would be one large group that nothing can meet
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    own = Window.partitionBy(*keys, "__span")
    upto = own.orderBy("__at", F.col("__fact").isNull(), "__fact").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.filter(some).withColumn("__inside", F.last("__fact", ignorenulls=True).over(upto))
    spans = both.filter(some).groupBy(*keys, "__span").agg(F.max("__fact").alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("__before", F.last("__last", ignorenulls=True).over(before)).select(*keys, "__span", "__before")
    lookups = seen.filter("__fact is null").join(carried, [*keys, "__span"])
    found = lookups.select(*asked.columns, F.coalesce("__inside", "__before").alias(fact))
    nowhere = asked.filter(~some).withColumn(fact, F.lit(None).cast(found.schema[fact].dataType))
    return found.unionByName(nowhere)


def numbered(rows: DataFrame, keys: Sequence[str], time: str, tie: str, number: str, seconds: int = SPAN) -> DataFrame:
    """Rows with their number within the keys, from 1, in order of time and ``tie``."""
    spanned = rows.withColumn("__span", _span(time, seconds))
    sizes = spanned.groupBy(*keys, "__span").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = Window.partitionBy(*keys, "__span").orderBy(time, tie)
    joined = spanned.withColumn("__own", F.row_number().over(own)).join(shifts, [*keys, "__span"])
    return joined.withColumn(number, F.col("__own") + F.col("__shift")).select(*rows.columns, number)


def lookup(asked: DataFrame, entries: DataFrame, tie: str, seconds: int = SPAN) -> DataFrame:
    """``asked`` with ``mode`` (primary, fallback or null), ``hit_key, created_at, answer, hits``.

    ``asked(cache_key, question, version, asked_at, ...)``;
    ``entries(cache_key, question, version, created_at, expires_at, answer)``.
    The newest entry of the key counts while it has not expired, else the newest
    of the question and version.  ``hits`` counts the lookups that an entry's
    key has served, this one included; ``tie`` orders those of one moment.
    """
    columns = asked.columns
    rest = ["expires_at", "answer"]
    primary = as_of(asked, entries.select("cache_key", "created_at", *rest), ["cache_key"], "asked_at", "created_at", "__primary", seconds)
    both = as_of(primary, entries.select("question", "version", "created_at", *rest, F.col("cache_key").alias("key")), ["question", "version"], "asked_at", "created_at", "__fallback", seconds)
    live = lambda c: F.col(f"{c}.expires_at") > F.col("asked_at")
    mode = F.when(live("__primary"), "primary").when(live("__fallback"), "fallback")
    pick = lambda a, b: F.when(F.col("mode") == "primary", a).when(F.col("mode") == "fallback", b)
    found = both.withColumn("mode", mode).select(
        *columns, "mode", pick(F.col("cache_key"), F.col("__fallback.key")).alias("hit_key"),
        pick(F.col("__primary.created_at"), F.col("__fallback.created_at")).alias("created_at"), pick(F.col("__primary.answer"), F.col("__fallback.answer")).alias("answer"),
    )
    hits = numbered(found.filter("mode is not null"), ["hit_key"], "asked_at", tie, "hits", seconds)
    return hits.unionByName(found.filter("mode is null").withColumn("hits", F.lit(0).cast("long")))


def upserted(entries: DataFrame, served: DataFrame, moment: Column) -> DataFrame:
    """``cache_key, question, version, created_at, expires_at, answer, hit_count, last_hit_at, expired``: the cache at ``moment``.

    An entry replaces what its key held before, but for the hits, which stay
    with the key; ``served`` are lookups with their ``hit_key`` and time.
    """
    whole = F.max(F.struct("created_at", "question", "version", "expires_at", "answer")).alias("e")
    now = entries.filter(F.col("created_at") <= moment).groupBy("cache_key").agg(whole).select("cache_key", "e.*")
    hits = served.filter(F.col("hit_key").isNotNull() & (F.col("asked_at") <= moment)).groupBy(F.col("hit_key").alias("cache_key")).agg(F.count(F.lit(1)).alias("hit_count"), F.max("asked_at").alias("last_hit_at"))
    joined = now.join(hits, "cache_key", "left")
    return joined.select("cache_key", "question", "version", "created_at", "expires_at", "answer", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), "last_hit_at", (F.col("expires_at") <= moment).alias("expired"))


def with_expiry(writes: DataFrame, written: str, ttl_seconds: int) -> DataFrame:
    """``created_at`` and ``expires_at`` of entries written at a time."""
    return writes.withColumns({"created_at": F.col(written), "expires_at": F.col(written) + F.make_dt_interval(secs=F.lit(ttl_seconds))})

"""Ingestion: validation by stage, fail-fast analysis, model input and vector hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failing_stage(html: Column, least: int = 900, most: int = 20_000) -> Column:
    """``struct(stage, retriable)``: the first stage a page fails, null if none; only fetching is worth another try."""
    stage = (
        F.when(F.length(html) < least, "fetch")
        .when(~F.contains(html, F.lit("<article>")), "parse")
        .when(F.regexp_extract(html, "<title>([^<]*)", 1) == "", "title")
        .when(F.length(html) > most, "chunk")
    )
    return F.struct(stage.alias("stage"), F.coalesce(stage == "fetch", F.lit(False)).alias("retriable"))


#: Values that must match: shortest page, text and title.
LEAST_HTML, LEAST_TEXT, LEAST_TITLE = 120, 120, 3


def page_fault(html: Column, status: Column, text: Column, title: Column, external_id: Column, chunks: Column, kept: Column, embedded: Column, least_html: int = LEAST_HTML, least_text: int = LEAST_TEXT) -> Column:
    """``struct(stage, reason, retriable)``: the first check that a page fails on its way to the index, null if none.

    The page's length and status, the length of its text, its title and id, the
    number of its chunks, of those that are no duplicates, and of those that
    got a vector.  Nulls count as empty or 0; only a status is worth another try.
    """
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    number = lambda c: F.coalesce(c.cast("long"), F.lit(0))
    blank = lambda c: size(F.btrim(c)) == 0

    def failed(stage: str, *reason: str | Column, retriable: bool = False) -> Column:
        said = F.concat(*(F.lit(r) if isinstance(r, str) else r.cast("string") for r in reason))
        return F.struct(F.lit(stage).alias("stage"), said.alias("reason"), F.lit(retriable).alias("retriable"))

    return (
        F.when(size(html) < least_html, failed("fetch-validate", "HTML response too short (", size(html), f" < {least_html})"))
        .when(~number(status).between(200, 299), failed("fetch-validate", "Unexpected HTTP status code: ", number(status), retriable=True))
        .when(size(text) < least_text, failed("parse-validate", "Parsed text too short (", size(text), f" < {least_text})"))
        .when(size(F.btrim(title)) < LEAST_TITLE, failed("parse-validate", "Missing parsed title"))
        .when(blank(external_id), failed("parse-validate", "Missing parsed externalId"))
        .when(number(chunks) == 0, failed("chunk", "Chunking produced zero chunks"))
        .when(number(kept) == 0, failed("chunk", "All chunks were dropped as duplicates"))
        .when(number(embedded) != number(kept), failed("embed-validate", "Embedded chunk count mismatch (", number(embedded), " != ", number(kept), ")"))
    )


def fail_fast(attempts: DataFrame, key: str, order: list[str], failed: Column, streak: int = 5, rate: float = 0.3, after: int = 10) -> DataFrame:
    """``key, attempt, reason``: the first attempt at which a run of failures or the error rate says stop."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = attempts.select(key, *order, failed.cast("int").alias("bad")).withColumns({
        "n": F.row_number().over(w).cast("long"),
        "errors": F.sum("bad").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "run": F.sum(1 - F.col("bad")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    })
    island = Window.partitionBy(key, "run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("streak", F.sum("bad").over(island))
    stops = marked.filter((F.col("streak") >= streak) | ((F.col("n") >= after) & (F.col("errors") / F.col("n") > rate)))
    reason = F.when(F.col("streak") >= streak, "streak").otherwise("rate")
    return stops.groupBy(key).agg(F.min("n").alias("attempt"), F.min_by(reason, "n").alias("reason"))


def prepare_for_model(text: Column, prefix: str = "passage: ", most: int = 3000) -> Column:
    """Prefix, line feeds folded; beyond ``most`` characters the first 70 % and the last 25 % of them."""
    flat = F.concat(F.lit(prefix), F.replace(text, F.lit("\n"), F.lit(" ")))
    head, tail = most * 70 // 100, most * 25 // 100
    cut = F.concat(F.substring(flat, 1, head), F.lit(" ... "), F.substring(flat, F.lit(-tail), F.lit(tail)))
    return F.when(F.length(flat) > most, cut).otherwise(flat)


def resized(vector: Column, dimensions: int) -> Column:
    """Cut or zero-padded to ``dimensions``; entries that are null or not finite become 0."""
    inf = float("inf")
    finite = F.transform(vector, lambda x: F.when(x.isNull() | F.isnan(x) | x.isin(inf, -inf), F.lit(0.0)).otherwise(x.cast("double")))
    padded = F.concat(finite, F.array_repeat(F.lit(0.0), F.greatest(F.lit(dimensions) - F.size(vector), F.lit(0))))
    return F.slice(padded, 1, dimensions)


def pending(found: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    """Keys of ``found`` that the checkpoint (``key, state``) does not hold as completed, and whether they ``failed_before``."""
    open_ = found.select(key).join(checkpoint.filter("state = 'completed'").select(key), key, "left_anti")
    failed = checkpoint.filter("state = 'failed'").select(key).distinct().withColumn("failed_before", F.lit(True))
    return open_.join(failed, key, "left").select(key, F.coalesce("failed_before", F.lit(False)).alias("failed_before"))

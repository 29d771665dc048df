"""Stored tables, deletes along foreign keys, and the expiring cache."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cache, store

SCHEMA = "source string, source_id string, id string, v long"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("part-*.parquet")}


@pytest.fixture
def documents(spark, tmp_path):
    held = store.Store(spark, f"{tmp_path}/documents", SCHEMA, ["source", "source_id"], 16)
    held.create(spark.createDataFrame([("s", str(i), f"old-{i}", i) for i in range(60)], SCHEMA))
    return held


def test_an_upsert_rewrites_what_it_touches(spark, documents):
    before = files(documents.path)
    delta = spark.createDataFrame([("s", "7", "new-7", 70), ("t", "7", "new-t7", 71)], SCHEMA)
    touched = documents.upsert(delta, keep=["id"])
    after = files(documents.path)
    kept = {f for f in before if int(f.split("=")[1].split("/")[0]) not in touched}
    assert len(touched) <= 2 and len(kept) > 40 * len(before) / 60 and all(after.get(f) == before[f] for f in kept)
    rows = {(r["source"], r["source_id"]): (r["id"], r["v"]) for r in documents.read().collect()}
    assert rows == {("s", str(i)): (f"old-{i}", i) for i in range(60)} | {("s", "7"): ("old-7", 70), ("t", "7"): ("new-t7", 71)}
    assert documents.upsert(delta.limit(0)) == [] and files(documents.path) == after
    documents.upsert(delta, keep=["id"])  # the same delivery again
    assert {(r["source"], r["source_id"]): (r["id"], r["v"]) for r in documents.read().collect()} == rows


def test_only_touched_buckets_are_read(documents):
    plan = documents.read([3, 5])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_children_are_replaced_and_empty_buckets_go(spark, documents, tmp_path):
    chunks = store.Store(spark, f"{tmp_path}/chunks", "source string, source_id string, n long", ["source", "source_id"], 16)
    chunks.create(spark.createDataFrame([("s", str(i), n) for i in range(60) for n in range(3)], chunks.schema))
    delta = spark.createDataFrame([("s", "7", 70), ("s", "8", 80), ("u", "1", 1)], "source string, source_id string, v long")
    store.upsert_documents(documents, chunks, delta, spark.createDataFrame([("s", "7", 9), ("u", "1", 1)], chunks.schema))
    found = sorted((r["source_id"], r["n"]) for r in chunks.read().filter("source_id in ('7', '8', '1')").collect())
    assert found == [("1", 0), ("1", 1), ("1", 1), ("1", 2), ("7", 9)]
    new = documents.read().filter("source = 'u'").first()
    assert len(new["id"]) == 36 and documents.read().filter("source_id = '8'").first()["id"] == "old-8"
    all_keys = documents.read().select("source", "source_id")
    chunks.replace_children(all_keys, chunks.read().limit(0))
    assert chunks.read().count() == 0 and files(chunks.path) == {}


def keys(found):
    return {name: sorted(tuple(r) for r in rows.collect()) for name, rows in found.items()}


def test_deletes_follow_foreign_keys(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "a": (make([(1, "x"), (2, "y"), (3, "x")], "id long, code string"), ["id"]),
        "b": (make([(10, 1), (11, 2), (12, None)], "id long, a_id long"), ["id"]),
        "c": (make([(20, 11, "x"), (21, 10, "y"), (22, 12, "q"), (23, None, None)], "id long, b_id long, code string"), ["id"]),
        "d": (make([(1, 1, 20), (1, 2, 21), (2, 1, 22)], "p long, q long, c_id long"), ["p", "q"]),
    }
    links = [("b", ["a_id"], "a", ["id"]), ("c", ["b_id"], "b", ["id"]), ("c", ["code"], "a", ["code"]), ("d", ["c_id"], "c", ["id"])]
    gone = store.cascade(tables, links, {"a": tables["a"][0].filter("id = 1")})
    assert keys(gone) == {"a": [(1,)], "b": [(10,)], "c": [(20,), (21,)], "d": [(1, 1), (1, 2)]}
    assert sorted(r["id"] for r in store.surviving(*tables["c"], gone["c"]).collect()) == [22, 23]
    both = store.cascade(tables, links, {"b": tables["b"][0].filter("id = 12"), "d": tables["d"][0].filter("p = 1 and q = 1")})
    assert keys(both) == {"b": [(12,)], "c": [(22,)], "d": [(1, 1), (2, 1)]}
    assert keys(store.cascade(tables, links, {})) == {} and store.surviving(*tables["a"], None).count() == 3
    with pytest.raises(ValueError, match="ring"):
        store.cascade(tables, [*links, ("a", ["id"], "d", ["p"])], {"a": tables["a"][0]})


def test_a_cascade_shuffles_no_other_columns(spark):
    wide = spark.createDataFrame([(1, 1, "text")], "id long, a_id long, body string")
    tables = {"a": (spark.createDataFrame([(1, "text")], "id long, body string"), ["id"]), "b": (wide, ["id"])}
    gone = store.cascade(tables, [("b", ["a_id"], "a", ["id"])], {"a": tables["a"][0]})
    joins = [line for line in gone["b"]._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert joins and not any("body" in line for line in joins)


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


ASKED = "cache_key string, question string, version string, asked_at timestamp_ntz, n long"
ENTRIES = "cache_key string, question string, version string, created_at timestamp_ntz, expires_at timestamp_ntz, answer long"


@pytest.mark.parametrize("seconds", [60, 6 * 3600, 10**9])
def test_lookups_see_the_newest_live_entry(spark, seconds):
    entries = spark.createDataFrame([
        ("k", "q", "v", at(1), at(11), 1), ("k", "q", "v", at(5), at(8), 2), ("old", "q", "v", at(6), at(20), 3), ("other", "q", "w", at(2), at(99), 4), (None, None, "v", at(0), at(99), 5),
    ], ENTRIES)
    asked = [("k", "q", "v", at(h), n) for n, h in enumerate((0, 1, 3, 5, 7.5, 8, 12, 21))] + [("z", "q", "w", at(2), 10), (None, None, "v", at(3), 11), ("k", "x", "v", at(30), 12)]
    found = {r["n"]: (r["mode"], r["hit_key"], r["answer"], r["hits"]) for r in cache.lookup(spark.createDataFrame(asked, ASKED), entries, "n", seconds).collect()}
    miss = (None, None, None, 0)
    assert found == {
        0: miss, 1: ("primary", "k", 1, 1), 2: ("primary", "k", 1, 2), 3: ("primary", "k", 2, 3), 4: ("primary", "k", 2, 4), 5: ("fallback", "old", 3, 1), 6: ("fallback", "old", 3, 2), 7: miss,
        10: ("fallback", "other", 4, 1), 11: miss, 12: miss,
    }


def test_upserts_keep_hits_and_renew_times(spark):
    entries = cache.with_expiry(spark.createDataFrame([("k", "q", "v", at(1), 1), ("k", "q", "v", at(5), 2), ("later", "q", "v", at(50), 3)], "cache_key string, question string, version string, t timestamp_ntz, answer long"), "t", 3600).drop("t")
    asked = spark.createDataFrame([("k", "q", "v", at(h), n) for n, h in enumerate((1.5, 3, 5.2, 5.9, 40))], ASKED)
    served = cache.lookup(asked, entries, "n")
    state = cache.upserted(entries, served, F.to_timestamp_ntz(F.lit("2024-01-01 05:30:00"))).collect()
    assert [(r["cache_key"], r["created_at"], r["expires_at"], r["answer"], r["hit_count"], r["last_hit_at"], r["expired"]) for r in state] == [("k", at(5), at(6), 2, 2, at(5.2), False)]
    state = cache.upserted(entries, served, F.to_timestamp_ntz(F.lit("2024-01-04 00:00:00"))).orderBy("cache_key").collect()
    assert [(r["cache_key"], r["hit_count"], r["expired"]) for r in state] == [("k", 3, True), ("later", 0, True)]


def test_a_hot_key_is_many_tasks(spark):
    """All lookups ask one key: none of the windows over rows holds more than a span of it."""
    hours = spark.range(24 * 50).select(F.lit("k").alias("cache_key"), F.lit("q").alias("question"), F.lit("v").alias("version"), F.timestamp_add("minute", F.col("id"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).alias("asked_at"), F.col("id").alias("n"))
    entries = spark.createDataFrame([("k", "q", "v", at(0), at(10**4), 1)], ENTRIES)
    found = cache.lookup(hours, entries, "n", 3600)
    assert found.agg(F.max("hits"), F.count_distinct("hits")).first() == (1200, 1200)
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line and "n#" in line.split("[")[-1]]
    assert all("__span" in line for line in windows)

"""Decontamination, fingerprints, line dedup and repetition rules against brute force, and on odd tables."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash
from comparing import compare
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, linededup, queries, repetition, simhash, store
from lodestone.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_items_with_edits_are_found_exactly_within_the_budget():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(200)]
    items = [" ".join(rnd.choice(words) for _ in range(rnd.randint(12, 40))) for _ in range(12)]
    table = decontaminate.build(list(range(12)), items, 8, 0.1)
    for _ in range(60):
        i = rnd.randrange(12)
        part = list(items[i])
        for _ in range(rnd.randint(0, int(table.edits[i] * 1.3) + 1)):
            j = rnd.randrange(len(part))
            part[j : j + rnd.randrange(2)] = rnd.choice(["", "x", "yz"])
        text = decontaminate.normal("".join(rnd.choice(["", "lead in text ", "qq"])) + "".join(part) + rnd.choice(["", " tail of the text"]))
        want = edits(items[i], text)
        found = {m[0]: m[1] for m in next(decontaminate.search([text], table))}
        assert found.get(i) == (want if want <= table.edits[i] else None)


def test_repeated_q_grams_cost_no_memory(monkeypatch):
    rnd = random.Random(12)
    dashes = "a heading " + "-" * 60 + " and what stands below it in the item"
    items = [dashes, "x" * 45, " ".join(f"word{i}" for i in range(20))]
    table = decontaminate.build([0, 1, 2], items, 8, 0.1)
    tracemalloc.start()
    found = next(decontaminate.search(["-" * 1_000_000], table))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [] and peak < 300e6
    text = "-" * 3000 + " " + items[2] + " " + "x" * 2000 + " a heading " + "-" * 58 + " and what stands below it in the item " + "-" * 500
    whole = next(decontaminate.search([text], table))
    monkeypatch.setattr(decontaminate, "STEP", 97)
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    assert next(decontaminate.search([text], table)) == whole and [m[:2] for m in whole] == [(0, 2), (1, 0), (2, 0)]
    for _ in range(30):
        mixed = "".join(rnd.choice(["-", "x", "--------", "word1 ", items[2][:40]]) for _ in range(60))
        monkeypatch.setattr(decontaminate, "STEP", 1 << 20)
        monkeypatch.setattr(decontaminate, "PAIRS", 1 << 20)
        points = decontaminate.codes(decontaminate.normal(mixed))
        want = decontaminate.regions(points, table)
        monkeypatch.setattr(decontaminate, "STEP", 31)
        monkeypatch.setattr(decontaminate, "PAIRS", 7)
        assert decontaminate.regions(points, table) == want


def test_short_items_are_found_exactly(spark):
    bench = spark.createDataFrame([(1, "Who was Ada?"), (2, "Paris"), (3, "a  CAT sat"), (4, "")], "item_id long, text string")
    texts = ["so who was  ada? she", "who was adam?", "paris", "in paris", "a cat sat.", "a cat sats; a cat sat", "xa cat sat", "who was ad?", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_items(docs, bench).collect()) == [(0, 1), (2, 2), (4, 3), (5, 3)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [1, 3, 6, 7, 8]


def test_blocks_of_items_find_the_same(spark, data, monkeypatch):
    docs, bench = (spark.read.parquet(f"{data}/{name}.parquet") for name in ("documents", "benchmark"))
    docs = docs.withColumn("matches", F.lit("own"))
    one = decontaminate.find_items(docs, bench).collect(), decontaminate.drop_contaminated(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", bench.agg(F.sum(F.length("text"))).first()[0] // 3)
    three = decontaminate.find_items(docs, bench).collect(), decontaminate.drop_contaminated(docs, bench).collect()
    assert [sorted(map(str, x)) for x in one] == [sorted(map(str, x)) for x in three]
    found = {r["doc_id"] for r in one[0]}
    assert found and {r["doc_id"] for r in one[1]} == {r["doc_id"] for r in docs.collect()} - found and {r["matches"] for r in one[1]} == {"own"}


def test_decontamination_query_matches_brute_force(spark, data):
    """Every document and item of the tables by full edit distance, where a shared 8-gram makes a match possible at all."""
    items = {r["item_id"]: decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    grams = {i: {t[j : j + 8] for j in range(len(t) - 7)} for i, t in items.items()}
    want = set()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        text = decontaminate.normal(r["text"] or "")
        own = {text[j : j + 8] for j in range(len(text) - 7)}
        for i, item in items.items():
            k = min(len(item) // 10, (len(item) - 8) // 8)
            if len(grams[i] & own) >= len(grams[i]) - 8 * k:
                row = np.zeros(len(text) + 1, np.int64)
                for c in item:
                    new = np.minimum(row + 1, np.concatenate(([row[0] + 1], row[:-1] + (np.array(list(text)) != c))))
                    row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
                if row.min() <= k:
                    want.add((r["doc_id"], i, int(row.min())))
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in queries.op1_decontamination(spark, data).collect()}
    assert want and got == want


def test_decontamination_on_odd_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, "The quick  BROWN fox jumps over the lazy dog while seven wizards"), (2, None), (3, "short"), (4, "the quick brown fox jumps over the lazy dog while seven wizards")], "item_id long, text string")
    found = sorted((r["doc_id"] or 0, r["item_id"], r["distance"]) for r in decontaminate.find_items(odd, bench).collect())
    assert found == sorted([(0, 1, 0), (5, 1, 0), (5, 1, 0), (5, 1, 0), (9, 1, 0), (10, 1, 0)])
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 6
    assert decontaminate.find_items(none, bench).count() == 0
    assert decontaminate.find_items(odd, bench.limit(0)).count() == 0


def brute_print(text, k=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash_matches_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    prints = {r["doc_id"]: brute_print(r["text"]) for r in docs.collect()}
    want = brute_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op2_simhash(spark, data).collect()}
    assert got == {d: (prints[d], want[d]) for d in prints}


def test_crowded_buckets_lose_no_link(spark):
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    values = {base}
    while len(values) < 700:  # a cloud around one value that fills coarse buckets, some of it out of reach
        v = base
        for _ in range(rnd.choice([1, 2, 2, 3, 5])):
            v ^= 1 << rnd.randrange(20)
        values.add(v)
    nodes = sorted(int(np.uint64(v).view(np.int64)) for v in values)
    want = brute_components(nodes, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    df = spark.createDataFrame([(n,) for n in nodes], "fp long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.links(df, 2)).collect()}
    assert {n: got.get(n, n) for n in nodes} == want


def test_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_of_similarity_are_joined(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    sets = {}
    for d, t in docs.collect():
        words = t.lower().split()
        sets[d] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                assert found[a] == found[b]
    for component in set(found.values()):
        members = [d for d in ids if found[d] == component]
        for d in members if len(members) > 1 else []:
            assert max(len(sets[d] & sets[x]) / len(sets[d] | sets[x]) for x in members if x != d) > 0.75


def test_links_are_decided_on_whole_shingle_sets(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    rows, want = [], {}
    for pair in range(160):
        words = [word() for _ in range(rnd.choice([400, 1200, 4000]))]
        shared, tail = len(words) - 4, 0
        bound = pair % 2
        while (shared - tail) / (shared + tail) >= 0.8:  # tail: changed words, each of which changes a shingle
            tail += 1
        tail -= bound  # the last tail at or above 0.8, or the first below
        other = words[: len(words) - tail] + [word() for _ in range(tail)]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
        want |= {2 * pair: 2 * pair, 2 * pair + 1: 2 * pair + (not bound)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()} == want


def test_a_class_of_several_chunks_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CLASS_BYTES", 4000)
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(80):
        words = list(words)
        words[rnd.randrange(120)] = f"x{rnd.randrange(10**9)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    prints = [brute_print(t, 5) for t in texts]
    close = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()} == brute_components(list(range(80)), close)


def test_simhash_on_odd_tables(odd, none):
    rows = simhash.components(odd).collect()
    assert len(rows) == odd.count()
    empty = {r["component_id"] for r in rows if r["fp"] == 0}
    assert empty == {None}  # a row without id is the smallest
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect()]
    assert len([t for t in texts if t and t.startswith("w0 ")]) == 1 and len([t for t in texts if not (t or "").strip()]) == 1
    assert simhash.components(none).count() == 0 and simhash.keep_one(none).count() == 0


def brute_lines(docs, min_chars=20, min_docs=3):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(blanks))
    order = lambda d: (d is not None, d or 0)
    held = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(order(d))
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and order(d) < max(held[key(x)]) for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return Counter(out)


def dropped(df):
    kept = linededup.apply_bitmaps(df, linededup.line_bitmaps(df), lines="n_lines", dropped="n_dropped")
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in kept.collect())


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_line_dedup_matches_brute_force_across_boundaries(spark, batch):
    rnd = random.Random(int(batch))
    pool = [f"a line that stands in many documents {i}" for i in range(8)] + ["short", "  A LINE that stands in many documents 1\t"]
    docs = [(rnd.choice([None, *range(40)]), "\n".join(rnd.choice(pool[: rnd.choice([1, 10])]) for _ in range(rnd.randint(0, 9)))) for _ in range(120)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert dropped(df) == brute_lines(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_line_dedup_on_odd_tables(odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert dropped(odd) == brute_lines(docs)
    assert linededup.drop_lines(odd).columns == odd.columns
    assert linededup.drop_lines(none).count() == 0


def test_bitmaps_round_trip():
    for positions in ([0], [5, 2], list(range(0, 3000, 7))):
        bits = linededup.unpack_bitmap(linededup.pack_bitmap(np.array(positions)))
        assert np.flatnonzero(~bits).tolist() == sorted(positions)


def brute_counts(text, least):
    words = WORD.findall(text)

    def spans(k):
        grams = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        return len({j for i in range(len(words) - k + 1) if grams[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})

    longest = 0
    while spans(longest + 1):
        longest += 1
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), spans(8), spans(least), longest]


def test_repetition_matches_brute_force():
    rnd = random.Random(9)
    texts = ["", "a", " \n ", "é b é b | é b", "x y z q w e r t " * 4, "\n".join(["a b c d e f g h i"] * 3)]
    texts += [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 50))) for _ in range(150)]
    found = repetition.measure(texts, 5)
    for i, text in enumerate(texts):
        assert [found[name][i] for name in repetition._NAMES] == brute_counts(text, 5)


def test_repetition_on_odd_tables(odd, none):
    rows = repetition.measure_texts(odd).collect()
    assert len(rows) == odd.count()
    assert all(not r["kept"] for r in rows if r["n_words"] < 20)
    assert {r["n_words"]: r["kept"] for r in rows}[30_000]
    kept = repetition.keep_good(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    assert repetition.measure_texts(none).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(name, spark, duck, data):
    compare(queries.QUERIES[name](spark, data), duck.sql(queries.ORACLE_SQL[name]))


def test_rows_that_repeat_are_hashed_once(spark):
    """100,000 rows of one text, half without an id, beside a near copy: each task passes on one set of hashes for each document."""
    words = [f"word{i}" for i in range(120)]
    text, close = " ".join(words), " ".join([*words[:-1], "other"])
    many = spark.range(0, 100_000, 1, 8).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = many.unionByName(spark.createDataFrame([(9, close)], "doc_id long, text string"))
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == [(None, text)]
    picked = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("pick"), "text")
    found = simhash._hashed(picked, picked.distinct(), "text", 5)
    assert found.count() == 3 and all(len(r["hashes"]) == 8 * 116 for r in found.collect())


def test_rounds_of_components_replace_each_other(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    before = store.made()
    found = connected_components(chain)
    assert len(store.made()) == len(before) + 1 and found.filter("component = 0").count() == 201
    store.remove(spark, store.made()[-1:])
    assert store.made() == before

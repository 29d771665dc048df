"""The stages of the pipeline against brute-force versions, each on what the stage before it kept."""

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_text_operators import brute_components, brute_counts, brute_lines, brute_print
from tokenizers import Tokenizer

from lodestone.llm import decontaminate, simhash
from lodestone.llm.store import stored


def good(text):
    words, _, _, _, repeated, covered, longest = brute_counts(text or "", 5)
    return not (words < 20 or 100 * repeated > 30 * words or 100 * covered > 30 * words or longest > 50)


def sets_of(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near(rows):
    """The smallest id of each group of similarity 0.8 or more, or of fingerprints within 2 bits."""
    sets, prints = {d: sets_of(t) for d, t in rows}, {d: brute_print(t, 5) for d, t in rows}

    def linked(a, b):
        shared = len(sets[a] & sets[b])
        return shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) or (prints[a] ^ prints[b]).bit_count() <= 2

    found = brute_components(sorted(sets), linked)
    return {d for d, root in found.items() if d == root}


def holds_item(text, items):
    for item in items:
        k = min(len(item) // 10, (len(item) - 8) // 8)
        grams = {item[j : j + 8] for j in range(len(item) - 7)}
        if sum(g in text for g in grams) >= len(grams) - 8 * k:
            row, points = np.zeros(len(text) + 1, np.int64), np.array(list(text))
            steps = np.arange(len(row))
            for c in item:
                new = np.minimum(row + 1, np.concatenate(([row[0] + 1], row[:-1] + (points != c))))
                row = np.minimum.accumulate(new - steps) + steps
            if row.min() <= k:
                return True
    return False


def test_stages_match_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    def step(name, docs):
        out = stored(stages[name](spark, docs, data), "test-" + name.replace(" ", "-"))
        return out, {r["doc_id"]: r["text"] for r in out.collect()} if name != "packing" else None

    docs, kept = step("quality rules", docs)
    assert kept == {d: t for d, t in rows.items() if good(t)} and docs.columns == columns
    docs, cut = step("line dedup", docs)
    assert Counter(cut.items()) == Counter({(d, t): n for (d, _, _, t), n in brute_lines(list(kept.items())).items()}) and docs.columns == columns
    docs, single = step("near dedup", docs)
    assert set(single) == near(list(cut.items())) and single.items() <= cut.items() and docs.columns == columns
    docs, clean = step("decontamination", docs)
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert set(clean) == {d for d, t in single.items() if not holds_item(decontaminate.normal(t), items)} and docs.columns == columns
    assert len(rows) > len(kept) > len(single) > len(clean) and cut != kept
    packed, _ = step("packing", docs)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {d: [] for d in clean}
    for r in packed.orderBy("doc_id", "start").collect():
        assert r["start"] == len(found[r["doc_id"]]) and r["offset"] + r["length"] <= 1024
        found[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert found == {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in clean.items()}


def test_near_dedup_finds_all_pairs_of_similarity(spark):
    """Recall over all pairs of a thousand documents: 1 from similarity 0.8 on; and what lies below is left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: sets_of(r["text"]) for r in docs.collect()}
    held = {}
    for d, own in sets.items():
        for shingle in own:
            held.setdefault(shingle, []).append(d)
    shared = Counter((a, b) for ids in held.values() for i, a in enumerate(ids) for b in ids[:i])
    pairs = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    above = [p for p, s in pairs.items() if s >= 0.8]
    assert sum(s < 1 for s in map(pairs.get, above)) >= 10
    assert all(found[a] == found[b] for a, b in above)
    grouped = {a for p in above for a in p}
    assert all(found[d] == d for d in sets if d not in grouped)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, data, none, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, none, data).count() == 0

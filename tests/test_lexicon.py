"""Lexicon tables against plain contains, and literal cases of profiles, rules and references."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexicon as lx


def plain_hits(texts, rows):
    """Each term looked for by itself."""
    out = Counter()
    for d, text in texts:
        low = (text or "").lower()
        for entry, term, how in {(e, t.strip().lower(), h) for e, t, h in rows if t.strip()}:
            for m in re.finditer(f"(?={re.escape(term)})", low):
                begins = m.start() == 0 or not low[m.start() - 1].isalnum()
                ends = m.start() + len(term) == len(low) or not low[m.start() + len(term)].isalnum()
                if how == "part" or (begins and (how == "prefix" or ends)):
                    out[d, entry] += 1
    return out


@pytest.mark.parametrize("block_bytes", [None, 2000])
def test_ten_thousand_terms_match_plain_contains(spark, block_bytes):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    rows = [(i % 9000, " ".join(word() for _ in range(rnd.choice((1, 1, 1, 2)))), rnd.choice(("part", "word", "prefix"))) for i in range(10_000 if block_bytes is None else 1500)]
    texts = [(i, " ".join(word().upper() if rnd.random() < 0.3 else word() for _ in range(rnd.randint(0, 60)))) for i in range(40)] + [(90, None), (91, ""), (92, "é")]
    docs, lexicon = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(rows + [(1, " ", "part")], "entry long, term string, how string")
    found = {(r["doc_id"], r["entry"]): r["n"] for r in lx.scan(docs, lexicon, block_bytes=block_bytes).groupBy("doc_id", "entry").agg(F.sum("n").alias("n")).collect()}
    assert found == plain_hits(texts, rows)


def test_short_terms_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "The art of articles"), (2, "ART!"), (3, "party")], "doc_id long, text string")
    lexicon = spark.createDataFrame([(1, "art"), (2, "arti"), (3, "of a")], "entry long, term string")
    assert sorted(map(tuple, lx.scan(docs, lexicon).collect())) == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1)]
    assert lx.scan(docs, lexicon.limit(0)).count() == 0 and lx.scan(docs.limit(0), lexicon).count() == 0


def test_groups_and_the_best_of_them(spark):
    docs = spark.createDataFrame([(1, "wine and beer"), (2, "bread, wine"), (3, "water")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("drink", "wine"), ("drink", "Beer"), ("drink", "beer"), ("food", "bread"), ("feast", "wine")], "g string, term string")
    scores = lx.group_scores(docs, lexicon, "g")
    assert sorted(map(tuple, scores.collect())) == [(1, "drink", 2), (1, "feast", 1), (2, "drink", 1), (2, "feast", 1), (2, "food", 1)]
    assert sorted(map(tuple, lx.best_group(scores, "g").collect())) == [(1, "drink", 2), (2, "drink", 1)]
    assert sorted(map(tuple, lx.best_group(scores, "g", floor=2).collect())) == [(1, "drink", 2)]


def test_a_profile(spark):
    lexicon = spark.createDataFrame([
        (1, "phrase", "notice period", "notice"), (2, "hint", "labour act", "Labour act"), (3, "signal", "contract", "contract"), (4, "domain", "dismiss worker", "labour"),
        (5, "domain", "rent", "housing"), (6, "domain", "contract", "labour"), (7, "domain", "law", "court"),
    ], "entry long, kind string, term string, label string")
    questions = spark.createDataFrame([(1, "Dismissing workers by the Labour Act, article 12.3: what notice period has a contract?"), (2, ""), (3, None), (4, "lawful 1234 rental")], "query_id long, text string")
    found = {r["query_id"]: r for r in lx.keyword_profile(questions, lexicon, ["the", "by"], "(ing|s)$", r"article\s*([0-9]+(?:\.[0-9]+)*)").collect()}
    one = found[1]
    assert one["topical"][:3] == ["dismiss", "worker", "labour"]
    assert one["phrases"] == ["notice"] and one["hints"] == ["Labour act"] and one["articles"] == ["12.3"] and one["domain"] == "labour" and one["signal_score"] == 1 + 1 + 2
    assert one["expansions"][:3] == ["notice", "Labour act", "article 12.3"] and len(one["expansions"]) == 4
    for empty in (found[2], found[3]):
        assert empty["domain"] == "unknown" and empty["signal_score"] == 0 and not empty["phrases"] and not empty["expansions"]
    assert found[4]["domain"] == "housing" and found[4]["topical"] == ["lawful", "rental"]  # "law" is a word of its own only


def test_rules_by_equality_prefix_and_content(spark):
    docs = spark.createDataFrame([(1, "long text about wine", "s1", True), (2, "wine", "s12", False), (3, "beer", None, None), (4, "wine", "t", True)], "doc_id long, text string, source string, good boolean")
    rules = spark.createDataFrame([("a", "contains", "text", "WINE", 0.5), ("a", "equals", "source", "s12", 0.9), ("a", "prefix", "source", "s1", 0.7), ("b", "equals", "good", "true", 0.3)], "rule string, kind string, field string, value string, score double")
    assert sorted(map(tuple, lx.rule_search(docs, rules, 2).collect())) == [("a", 1, 0.7, 2), ("a", 2, 0.9, 1), ("b", 1, 0.3, 2), ("b", 4, 0.3, 1)]


def test_scenarios_need_and_veto(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "alpha beta gamma"), (4, "alpha alpha")], "doc_id long, text string")
    rules = spark.createDataFrame([("s", "need", "alpha", 2), ("s", "need", "beta", 2), ("s", "veto", "gamma", 2)], "scenario string, part string, term string, fewest int")
    assert [tuple(r) for r in lx.scenarios(docs, rules).collect()] == [("s", 1, 2)]


def test_legal_references(spark):
    text = "By 2001/75 and 1989/12, Article 5, article 501 and 7 article. Case No 213350 and case no 099999, before the Northern high court. A right!"
    docs = spark.createDataFrame([(1, text), (2, None)], "d long, t string")
    lexicon = spark.createDataFrame([(1, "right"), (2, "duty")], "entry long, term string")
    found = {r["d"]: r for r in lx.legal_references(docs, lexicon, "d", "t", "Case", r"(?i)([^,\n.!?]{3,50}?)\s+(?:high|district)\s+court").collect()}
    assert {c: sorted(found[1][c]) for c in ("laws", "articles", "cases", "courts", "keywords")} == {"laws": ["2001/75"], "articles": ["5", "7"], "cases": ["213350"], "courts": ["before the Northern"], "keywords": ["right"]}
    assert not any(found[2][c] for c in ("laws", "articles", "cases", "courts", "keywords"))

"""Scores by rules in order, tracks of texts, and hits of one track."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import boosts
from lodestone.operators import fuse as fs
from lodestone.operators.boosts import Rule


def score_of(spark, evidence, rules, score=0.5):
    row = spark.range(1).select(boosts.folded(F.lit(score), boosts.evidence_of(**{k: F.lit(v) for k, v in evidence.items()}), rules).alias("s"))
    return row.first()["s"]


def test_damping_comes_in_order(spark):
    add, damp = Rule("x", add=0.2), Rule("y", factor=0.5)
    both = {"x": 1, "y": True}
    assert score_of(spark, both, [add, damp]) == pytest.approx(0.35)
    assert score_of(spark, both, [damp, add]) == pytest.approx(0.45)
    assert score_of(spark, {"x": 0}, [add, damp]) == 0.5 and score_of(spark, {"z": None}, [add]) == 0.5


def test_counts_are_capped_and_absence_counts(spark):
    each, missing = Rule("n", each=0.05, most=0.15), Rule("n", present=False, factor=0.72)
    assert [score_of(spark, {"n": n}, [each, missing]) for n in (0, 1, 2, 3, 9)] == pytest.approx([0.36, 0.55, 0.6, 0.65, 0.65])
    assert score_of(spark, {"n": 9}, [Rule("n", add=2, most=2)]) == 1.0 and score_of(spark, {"n": 9}, [Rule("n", add=-2)]) == 0.0


def test_boosts_of_laws_and_topics(spark):
    assert score_of(spark, {"preferred": 1, "broad_preferred": 1}, boosts.BOOSTS) == pytest.approx(0.74)
    assert score_of(spark, {"broad_other": 1, "broad_low_authority": 1, "topic_law": 1, "signals": 2, "boilerplate": 1}, boosts.BOOSTS) == pytest.approx(((0.5 * 0.76 * 0.5) + 0.18 + 0.1) * 0.55)


def test_tracks_are_told_by_terms(spark):
    docs = spark.createDataFrame([(1, "contract damages"), (2, "theft and damages"), (3, "weather")], "d long, text string")
    lexicon = spark.createDataFrame([("a", "contract"), ("a", "damages"), ("b", "theft"), ("b", "damages")], "track string, term string")
    found = boosts.track_counts(docs, lexicon, ("a", "b"), "d")
    rows = found.select("d", "first", "second", boosts.leaning(F.col("first"), F.col("second"), ("a", "b"), "none").alias("t"), boosts.leaning(F.col("first"), F.col("second"), ("a", "b"), "none", 1.0).alias("far"))
    assert sorted(map(tuple, rows.collect())) == [(1, 2, 1, "a", "none"), (2, 1, 2, "b", "none")]


def kept(spark, tracks, preference, scores=None):
    rows = [(1, i, (scores or [0.9 - 0.01 * i for i in range(len(tracks))])[i], t, preference) for i, t in enumerate(tracks)]
    hits = spark.createDataFrame(rows, "query_id long, id long, score double, track string, preference string")
    return "".join(str(r["id"]) for r in boosts.one_track(hits).orderBy("id").collect())


def test_one_track_stays(spark):
    u = "unknown"
    assert kept(spark, ["a", "b", "a", u, "a"], "a") == "0234"
    assert kept(spark, ["a", "b", "a", u], "a") == "0123"  # two of the preferred track are too few
    assert kept(spark, ["b", "b", "b", "a", u], "neutral") == "0124"
    assert kept(spark, ["b", "b", "b", "a", "a"], "neutral") == "01234"  # not two more
    assert kept(spark, ["b", "b", "b", "a", u], "neutral", [0.2, 0.2, 0.2, 0.9, 0.1]) == "01234"  # not by score
    assert kept(spark, ["a", "a", "a", u, u, u, "b", "b"], "neutral") == "012345"  # those beyond six do not count


def test_scores_are_rounded_as_in_sql(spark, duck):
    """The product of a rule that is a half of the sixth digit, but for the last bit of the double."""
    scores = [0.27607349999999997, 0.2760735, 0.2760734, 0.5, 0.0, 1.0, None]
    rows = spark.createDataFrame([(x,) for x in scores], "score double").select(fs.rounded(F.col("score")).alias("score")).collect()
    assert [r["score"] for r in rows] == [duck.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchall()[0][0] for x in scores]
    assert rows[0]["score"] == 0.276074

"""Scores changed by rules: what a hit shows, in the order of the rules; and hits of one track kept together.

Evidence is a map from names to counts in each hit's row.  Rules are rows too:
each looks at one name, adds or multiplies, and they are folded in order, so
that what damps a score damps what came before it and nothing that comes after.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.fuse import clamp
from lodestone.operators.lexicon import group_scores


class Rule(NamedTuple):
    """If ``evidence`` is there (or, ``present`` false, is not): add ``add`` and ``each`` for each count, up to ``most``; then multiply by ``factor``."""

    evidence: str
    present: bool = True
    add: float = 0.0
    each: float = 0.0
    most: float = 1.0
    factor: float = 1.0


#: Values that must match: boosts of laws and topics, in order.  ``broad_`` evidence is that of questions for an overview.
BOOSTS = (
    Rule("preferred", add=0.12), Rule("broad_preferred", add=0.12), Rule("canonical", add=0.06), Rule("broad_canonical", add=0.06), Rule("broad_clause", add=0.06), Rule("broad_other", factor=0.76),
    Rule("low_authority", factor=0.72), Rule("broad_low_authority", factor=0.5), Rule("aligned_article", add=0.15), Rule("topic_law", add=0.18), Rule("topic_article", add=0.12),
    Rule("signals", each=0.05, most=0.15), Rule("no_signal", factor=0.72), Rule("boilerplate", factor=0.55),
)
#: Values that must match: cases by domain and track, in order.
TRACK_RULES = (
    Rule("topic", each=0.05, most=0.18), Rule("signal", each=0.03, most=0.12), Rule("no_signal", factor=0.82), Rule("same_track", add=0.18), Rule("other_track", factor=0.68),
    Rule("own_matches", each=0.04, most=0.12), Rule("other_matches", factor=0.9), Rule("leading_track", add=0.08),
)


def folded(score: Column, evidence: Column, rules: Sequence[Rule]) -> Column:
    """The score after all rules, within 0 and 1; a name that the evidence lacks counts 0."""
    table = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(Rule._fields, r, strict=True))) for r in rules))

    def step(s: Column, r: Column) -> Column:
        n = F.coalesce(F.element_at(evidence, r["evidence"]).cast("double"), F.lit(0.0))
        gain = F.least(r["add"] + F.when(r["present"], n).otherwise(0.0) * r["each"], r["most"])
        return F.when((n > 0) == r["present"], (s + gain) * r["factor"]).otherwise(s)

    return clamp(F.aggregate(table, score.cast("double"), step))


def evidence_of(**counts: Column) -> Column:
    """A map of evidence from conditions and counts."""
    parts = [x for name, c in counts.items() for x in (F.lit(name), F.coalesce(c.cast("double"), F.lit(0.0)))]
    return F.create_map(*parts)


def track_counts(docs: DataFrame, lexicon: DataFrame, tracks: tuple[str, str], doc_id: str, text: str = "text") -> DataFrame:
    """``<doc_id>, first, second``: how many distinct terms of each track a text holds; texts without any are left out."""
    scores = group_scores(docs, lexicon, "track", doc_id, text)
    count = lambda t: F.coalesce(F.max(F.when(F.col("track") == t, F.col("score"))), F.lit(0))
    return scores.groupBy(doc_id).agg(count(tracks[0]).alias("first"), count(tracks[1]).alias("second"))


def leaning(first: Column, second: Column, tracks: tuple[str, str], otherwise: str, margin: float = 0.0) -> Column:
    """The track that is ahead by more than ``margin``."""
    return F.when(first > second + margin, tracks[0]).when(second > first + margin, tracks[1]).otherwise(otherwise)


def track_evidence() -> Column:
    """Evidence of a row (``track, preference, first, second, topic, signal, signals_asked``): tracks are named a and b, and ``first`` and ``second`` count their terms in the hit."""
    wanted, own = F.col("preference"), F.col("track")
    a_wanted, b_wanted = wanted == "a", wanted == "b"
    mine = F.when(a_wanted, F.col("first")).when(b_wanted, F.col("second")).otherwise(0)
    other = F.when(a_wanted, F.col("second")).when(b_wanted, F.col("first")).otherwise(0)
    neutral = ~(a_wanted | b_wanted)
    leads = ((own == "a") & (F.col("first") > F.col("second"))) | ((own == "b") & (F.col("second") > F.col("first")))
    return evidence_of(
        topic=F.col("topic"), signal=F.col("signal"), no_signal=(F.col("signals_asked") > 0) & (F.col("signal") == 0), same_track=~neutral & (own == wanted),
        other_track=~neutral & own.isin("a", "b") & (own != wanted), own_matches=mine, other_matches=other > 0, leading_track=neutral & leads,
    )


def one_track(hits: DataFrame, within: int = 6, fewest: int = 3, lead: int = 2, ratio: float = 1.35) -> DataFrame:
    """Hits (``query_id, id, score, track, preference``, tracks a and b) of the preferred track and of none, if it has ``fewest``.

    Without a preference the track counts that leads among the first ``within``:
    ``fewest`` hits, ``lead`` more than the other, and ``ratio`` times its sum of
    scores.  Otherwise all hits stay.
    """
    w = Window.partitionBy("query_id")
    near = F.col("__rank") <= within
    rows = hits.withColumn("__rank", F.row_number().over(w.orderBy(F.desc("score"), "id")))
    of = lambda t: F.col("track") == t
    sums = {f"__{name}_{t}": agg.over(w) for t in "ab" for name, agg in {"all": F.count_if(of(t)), "n": F.count_if(of(t) & near), "s": F.sum(F.when(of(t) & near, F.col("score")).otherwise(0.0))}.items()}
    rows = rows.withColumns(sums)

    def ahead(t: str, o: str) -> Column:
        c = lambda name: F.col(f"__{name}")
        return (c(f"n_{t}") >= fewest) & (c(f"n_{t}") >= c(f"n_{o}") + lead) & (c(f"s_{t}") >= F.round(c(f"s_{o}") * ratio, 9))

    asked = F.col("preference")
    chosen = F.when(asked.isin("a", "b"), F.when(F.when(asked == "a", F.col("__all_a")).otherwise(F.col("__all_b")) >= fewest, asked)).when(ahead("b", "a"), "b").when(ahead("a", "b"), "a")
    kept = rows.withColumn("__kept", chosen).filter("__kept is null or track = __kept or track = 'unknown'")
    return kept.select(*hits.columns)

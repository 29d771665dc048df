"""Fusion, reranking, filters and result lists over hit tables ``query_id, id, score, rank``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.rows import ranked, top_k

QUERY = ["query_id"]


def best() -> list[Column]:
    """Highest score first, ties by id."""
    return [F.desc("score"), F.col("id")]


def clamp(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(score, F.lit(low)), F.lit(high))


def rounded(score: Column, digits: int = 6) -> Column:
    """A score from 0 on rounded as its SQL does, by its scaled value; ``F.round`` goes by the digits of the double, which may lie just below a half."""
    scale = 10.0**digits
    return F.floor(score * scale + 0.5) / scale


def reciprocal_rank_fusion(vector: DataFrame, keyword: DataFrame, constant: int = 60) -> DataFrame:
    """``query_id, id, vector_score, keyword_score, rrf_score, source, rank``: sum of 1 / (constant + rank) over both lists."""
    v = vector.select("query_id", "id", F.col("score").alias("vs"), (1 / (constant + F.col("rank"))).alias("vr"))
    k = keyword.select("query_id", "id", F.col("score").alias("ks"), (1 / (constant + F.col("rank"))).alias("kr"))
    both = v.join(k, ["query_id", "id"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    source = F.when(F.col("vr").isNull(), "keyword").when(F.col("kr").isNull(), "vector").otherwise("both")
    fused = both.select(
        "query_id", "id", zero(F.col("vs")).alias("vector_score"), zero(F.col("ks")).alias("keyword_score"),
        F.round(zero(F.col("vr")) + zero(F.col("kr")), 9).alias("rrf_score"), source.alias("source"),
    )
    return ranked(fused, QUERY, [F.desc("rrf_score"), F.col("id")])


def adaptive_score(fused: DataFrame, vector: DataFrame, weak: float = 0.5, very_weak: float = 0.2) -> DataFrame:
    """``query_id, id, score, raw_score``: the mean vector score of a question picks one of three weightings; without vector hits keywords count 0.5 at least."""
    mean = vector.groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("mean"))
    v, k, r = F.col("vector_score"), F.col("keyword_score"), F.col("rrf_score")
    capped = lambda factor, most=1.0: F.least(r * factor, F.lit(most))
    score = (
        F.when(F.col("mean").isNull(), clamp(F.greatest(k, F.lit(0.5))))
        .when(F.col("mean") < very_weak, F.greatest(k * 1.5, v * 0.5, capped(15)))
        .when(F.col("mean") < weak, F.greatest(k * 1.3, v, capped(12)))
        .otherwise(F.greatest(v * 1.1, k, capped(10)))
    )
    raw = F.when(F.col("mean").isNull(), clamp(k)).otherwise(F.greatest(v, k, capped(10, 0.85)))
    joined = fused.join(mean, "query_id", "left")
    return joined.select("query_id", "id", F.round(score, 9).alias("score"), F.round(raw, 9).alias("raw_score"))


def score_distribution(hits: DataFrame) -> DataFrame:
    """``query_id, lowest, highest, mean, median``: the median is the upper one."""
    scores = F.sort_array(F.collect_list("score"))
    return hits.groupBy("query_id").agg(
        F.min("score").alias("lowest"), F.max("score").alias("highest"), F.round(F.avg("score"), 6).alias("mean"), scores.alias("s")
    ).select("query_id", "lowest", "highest", "mean", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("median"))


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` stands in ``text``, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def heuristic_rerank(hits: DataFrame, terms: Column, text: Column, official: Column, generic: list[str], n: int) -> DataFrame:
    """``query_id, id, score, rank``: keyword, signal-term, position and source bonuses on the old score; the first n."""
    low = F.lower(text)
    counted = F.transform(terms, lambda t: F.struct(t.alias("t"), occurrences(low, t).alias("n")))
    total = lambda items: F.aggregate(items, F.lit(0), lambda s, x: s + x["n"])
    signal = F.filter(F.col("__c"), lambda x: ~x["t"].isin(*generic))
    rows = hits.withColumn("__c", counted).withColumns({
        "__n": total(F.col("__c")), "__s": total(signal), "__k": F.size(signal), "__of": F.count(F.lit(1)).over(Window.partitionBy("query_id")),
    })
    base = F.col("score") + F.least(F.col("__n") * 0.03, F.lit(0.35))
    signalled = F.when(F.col("__k") == 0, base).when(F.col("__s") == 0, base * 0.35).otherwise(base + F.least(F.col("__s") * 0.08, F.lit(0.35)))
    score = signalled + 0.05 * (1 - (F.col("rank") - 1) / F.col("__of")) + F.when(official, 0.05).otherwise(0.0)
    scored = rows.select("query_id", "id", F.round(clamp(score), 6).alias("score"))
    return top_k(scored, QUERY, best(), n)


def hybrid_rerank(
    hits: DataFrame, terms: Column, title: Column, body: Column, n: int, law: Column | None = None, knowledge: Column | None = None, expansions: Column | None = None, stored: Column | None = None, chars: int = 1600
) -> DataFrame:
    """``query_id, id, score, rank``: the old score plus six capped bonuses, the first n.

    Matches are terms that stand anywhere in the title and the first ``chars``
    of the body, in lower case: the question's ``terms`` (0.08 each, four at
    most; 0.2 for the share of them in the title), ``knowledge`` of its domain
    (0.12 for the share), ``expansions`` that are no terms (0.15 for any).
    ``law``: a law it asks for is named (0.15); ``stored`` keywords of the row
    that are terms (0.06 for any).
    """
    none = F.array().cast("array<string>")
    law = F.lit(False) if law is None else law
    knowledge, expansions, stored = (none if c is None else c for c in (knowledge, expansions, stored))
    corpus = F.lower(F.concat(title, F.lit(" "), F.substring(body, 1, chars)))
    rows = hits.select("query_id", "id", "score", corpus.alias("__c"), F.lower(title).alias("__t"), terms.alias("__q"), law.alias("__l"), knowledge.alias("__k"), F.array_except(expansions, terms).alias("__e"), stored.alias("__s"))
    matches = lambda words, where: F.size(F.filter(words, lambda w: F.contains(F.col(where), w)))
    share = lambda found, words: F.least(F.lit(1.0), found / F.greatest(F.size(words), F.lit(1)))
    score = (
        clamp(F.col("score"))
        + F.least(matches("__q", "__c"), F.lit(4)) * 0.08
        + share(matches("__q", "__t"), F.col("__q")) * 0.2
        + F.when(F.col("__l"), 0.15).otherwise(0.0)
        + share(matches("__k", "__c"), F.col("__k")) * 0.12
        + F.least(matches("__e", "__c"), F.lit(1)) * 0.15
        + F.least(F.size(F.array_intersect("__s", "__q")), F.lit(1)) * 0.06
    )
    return top_k(rows.select("query_id", "id", F.round(clamp(score), 6).alias("score")), QUERY, best(), n)


def scenario_fallback(hits: DataFrame, extra: DataFrame, relevant: DataFrame, within: int = 12, fewest: int = 3, floor: float = 0.5, boost: float = 0.1) -> DataFrame:
    """``query_id, id, score``: where fewer than ``fewest`` of a question's first ``within`` hits are relevant, its ``extra`` hits come in.

    ``relevant(query_id, id)`` names the pairs that suit the scenario.  Of the
    extra hits the relevant ones are kept, boosted and raised to ``floor``; an
    id in both lists has its higher score.  A question without hits counts as
    one without relevant ones.
    """
    good = relevant.select("query_id", "id").distinct()
    enough = hits.filter(F.col("rank") <= within).join(good, ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= fewest)
    added = extra.join(enough.select("query_id"), "query_id", "left_anti").join(good, ["query_id", "id"], "left_semi")
    raised = added.select("query_id", "id", F.round(clamp(F.greatest(F.col("score") + boost, F.lit(floor))), 6).alias("score"))
    return hits.select("query_id", "id", "score").unionByName(raised).groupBy("query_id", "id").agg(F.max("score").alias("score"))


def reference_bonus(score: Column, n_ids: Column, n_articles: Column) -> Column:
    """0.1 for any id and 0.05 for each article, 0.15 at most, on top of the score."""
    return F.least(score + F.when(n_ids > 0, 0.1).otherwise(0.0) + F.least(n_articles * 0.05, F.lit(0.15)), F.lit(1.0))


def candidate_gate(hits: DataFrame, least: float = 0.03, limit: int = 30) -> DataFrame:
    """Best row of each id from ``least`` on, the first ``limit``."""
    merged = hits.filter(F.col("score") >= least).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top_k(merged, QUERY, best(), limit)


def finalize_display(hits: DataFrame) -> DataFrame:
    """``display_score`` to two digits from evidence (``raw_score``), rank score, spread and position, within 0.12 and 0.94."""
    w = Window.partitionBy("query_id")
    e, s = clamp(F.col("raw_score")), clamp(F.col("score"))
    rows = hits.withColumns({"__low": F.min(e).over(w), "__high": F.max(e).over(w), "__n": F.count(F.lit(1)).over(w)})
    width = F.col("__high") - F.col("__low")
    spread = F.when(width >= 0.025, clamp((e - F.col("__low")) / width)).otherwise(0.5)
    place = F.when(F.col("__n") > 1, 1 - (F.col("rank") - 1) / (F.col("__n") - 1)).otherwise(1.0)
    shown = F.round(e * 0.72 + s * 0.18 + spread * 0.07 + place * 0.03, 9)
    shown = F.when((e < 0.25) & (s < 0.4), F.least(shown, F.lit(0.54))).otherwise(shown)
    shown = F.when((e > 0.85) & (width < 0.04), F.least(shown, F.lit(0.88))).otherwise(shown)
    return rows.withColumn("display_score", F.round(clamp(shown, 0.12, 0.94), 2)).drop("__low", "__high", "__n")


def retrieval_quality(hits: DataFrame, agrees: Column, canonical: Column) -> DataFrame:
    """``query_id, overall, precision, coverage, top, band``: 0.5 top score + 0.3 share of agreeing hits + 0.2 any canonical hit."""
    g = hits.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, clamp(F.col("score")))).alias("top"),
        F.avg(agrees.cast("double")).alias("precision"), F.max(canonical.cast("double")).alias("coverage"),
    )
    overall = F.round(clamp(F.col("top") * 0.5 + F.col("precision") * 0.3 + F.col("coverage") * 0.2), 9)
    band = F.when(overall >= 0.72, "high").when(overall >= 0.45, "medium").otherwise("low")
    return g.select("query_id", F.round(overall, 2).alias("overall"), F.round("precision", 2).alias("precision"), "coverage", F.round("top", 2).alias("top"), band.alias("band"))

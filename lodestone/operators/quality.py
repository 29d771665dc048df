"""Quality of answers in full, what may go into the cache, and whether an answer's articles are backed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import collapse_space
from lodestone.operators.fuse import clamp
from lodestone.operators.rows import top_k

#: Values that must match: weights and limits of the answer's metrics.
WEIGHTS = {"retrieval": 0.3, "citation": 0.25, "faithfulness": 0.3, "latency": 0.15}
CITATION = {"source": 0.45, "law": 0.35, "article": 0.2}
NO_CITATIONS, NO_ITEMS, SHORT_ANSWER, LEAST_BUDGET = 0.55, 0.75, 80, 1000


def _ratio(items: Column, good) -> Column:
    """Share of the items that are good; ``NO_ITEMS`` without any."""
    n = F.size(items)
    return F.when(n == 0, NO_ITEMS).otherwise(F.size(F.filter(items, good)) / n)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#\s]+)", 1))


def valid_source(source: Column, hosts: Mapping[str, str]) -> Column:
    """Whether a source's address is at the host of its type, or below it."""
    fits = F.lit(False)
    for kind, name in hosts.items():
        fits = fits | ((source["type"] == kind) & ((_host(source["url"]) == name) | F.endswith(_host(source["url"]), F.lit(f".{name}"))))
    return F.coalesce(fits, F.lit(False))


def _said(text: Column) -> Column:
    return F.length(F.btrim(F.coalesce(text, F.lit("")))) > 0


def answer_metrics(answers: DataFrame, keys: Sequence[str], hosts: Mapping[str, str], leaks: Sequence[str], no_info: str, unfinished: str) -> DataFrame:
    """``keys, retrieval, citation, faithfulness, latency, overall, issues``: an answer's metrics, each within 0 and 1 to three digits, and what is wrong with it.

    ``answers(answer, sources array<struct<type, url>>, laws array<struct<title,
    url, article_no>>, retrieval_overall, retrieval_timed_out,
    generation_timed_out, mode, latency_ms, budget_ms)``; null lists are empty,
    null flags false.  ``leaks``, ``no_info`` and ``unfinished`` are patterns.
    """
    sources, laws = (F.coalesce(F.col(c), F.array().cast(answers.schema[c].dataType)) for c in ("sources", "laws"))
    text = F.lower(collapse_space(F.coalesce("answer", F.lit(""))))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    bare = (F.size(sources) == 0) & (F.size(laws) == 0)
    valid, known, article = _ratio(sources, lambda s: valid_source(s, hosts)), _ratio(laws, lambda x: _said(x["title"]) & _said(x["url"])), _ratio(laws, lambda x: _said(x["article_no"]))
    citation = F.when(bare, NO_CITATIONS).otherwise(valid * CITATION["source"] + known * CITATION["law"] + article * CITATION["article"])
    overall = F.col("retrieval_overall")
    timed_out, none = flag("retrieval_timed_out"), F.coalesce(F.col("mode") == "no-info", F.lit(False))
    retrieval = F.when(timed_out, F.greatest(F.lit(0.45), F.coalesce(overall, F.lit(0.45)))).when(none, 1.0).when(overall.isNotNull(), overall).when(bare, 0.45).otherwise(0.7)
    short, leaking, ending, empty = F.length(text) < SHORT_ANSWER, F.col("answer").rlike("|".join(leaks)), text.rlike(unfinished), text.rlike(no_info)
    leaking = F.coalesce(leaking, F.lit(False))
    off = lambda condition, amount: F.when(condition, amount).otherwise(0.0)
    faith = 1 - off(short, 0.35) - off(empty, 0.35) - off(leaking, 0.25) - off(ending, 0.2)
    budget = F.greatest(F.lit(LEAST_BUDGET), F.col("budget_ms"))
    late = F.col("latency_ms") > budget
    speed = F.when(late, budget / F.greatest("latency_ms", budget)).otherwise(1.0)
    asked = ~timed_out & ~none
    issues = F.array_compact(F.array(
        F.when(timed_out, "retrieval_timeout_fallback"), F.when(asked & (overall < 0.5), "low_retrieval_quality"), F.when(asked & overall.isNull() & bare, "no_retrieval_signal"),
        F.when(bare, "no_citations"), F.when(~bare & (valid < 0.8), "invalid_source_url"), F.when(~bare & (article < 0.5), "weak_article_citation"), F.when(short, "answer_too_short"), F.when(empty, "no_info_answer"),
        F.when(leaking, "internal_word_leak"), F.when(ending, "possibly_incomplete_sentence"), F.when(late, "latency_budget_exceeded"), F.when(flag("generation_timed_out"), "generation_timeout_fallback"),
    ))
    parts = {"retrieval": retrieval, "citation": citation, "faithfulness": faith, "latency": speed}
    whole = sum((parts[n] * w for n, w in WEIGHTS.items()), F.lit(0.0))
    metric = lambda c: F.round(clamp(F.round(c, 9)), 3)
    return answers.select(*keys, *(metric(c).alias(n) for n, c in parts.items()), metric(whole).alias("overall"), issues.alias("issues"))


#: Values that must match: shortest question that is cached, least quality of what is.
SHORTEST, LEAST_QUALITY = 12, 0.55


def lookup_reason(scope: Column, intent: Column, skipped: Column, carry: Column, early: Column, form: Column, risky: Column, enabled: bool = True) -> Column:
    """Why a question is not looked up in the cache, the first reason; null if it is.  ``form`` is its normal form, ``risky`` whether it holds personal data."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(F.lit(not enabled), "cache_disabled")
        .when(no(scope != "legal") | scope.isNull(), "non_legal_scope")
        .when(no(intent == "unknown") | intent.isNull(), "unknown_intent")
        .when(no(skipped), "follow_up_or_retrieval_skipped")
        .when(no(carry != "full_refresh"), "not_full_refresh")
        .when(no(early), "early_response")
        .when((F.length(F.coalesce(form, F.lit(""))) < SHORTEST) | no(risky), "question_not_cache_eligible_or_pii")
    )


def storable(quality: Column, chunks: Column, sources: Column, laws: Column, least: float = LEAST_QUALITY) -> Column:
    """``struct(eligible, reason)``: whether a result is kept: by its quality, or by two chunks, a source and a law."""
    good, grounded = F.coalesce(quality, F.lit(0.0)) >= least, (chunks >= 2) & (sources >= 1) & (laws >= 1)
    reason = F.when(good, "quality_score").when(grounded, "grounded_context").otherwise("low_quality_and_sparse_context")
    return F.struct((good | F.coalesce(grounded, F.lit(False))).alias("eligible"), reason.alias("reason"))


def allowed_articles(hits: DataFrame, key: str, articles: Column, score: Column, rank: Column, within: int = 6, most: int = 4, least: float = 0.1) -> DataFrame:
    """``<key>, allowed``: the articles with the highest sums of scores over the first ``within`` hits, each hit counting ``least`` at least; of equal sums the smaller."""
    rows = hits.filter(rank <= within).select(key, F.explode(F.array_distinct(articles)).alias("article"), F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(least)).alias("s")).filter("article <> ''")
    sums = rows.groupBy(key, "article").agg(F.round(F.sum("s"), 9).alias("s"))
    best = top_k(sums, [key], [F.desc("s"), F.col("article")], most, "place")
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "article"))), lambda x: x["article"]).alias("allowed"))


def ungrounded(answers: DataFrame, key: str, said: Column, allowed: DataFrame) -> DataFrame:
    """``answers`` with ``allowed`` and ``ungrounded``: articles that an answer names and its hits do not back."""
    none = F.array().cast("array<string>")
    joined = answers.withColumn("__said", F.array_distinct(said)).join(allowed, key, "left").withColumn("allowed", F.coalesce("allowed", none))
    return joined.withColumn("ungrounded", F.array_except("__said", "allowed")).drop("__said")

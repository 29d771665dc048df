"""Evaluation metrics over tables of hits and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import collapse_space


def _metric(value: Column) -> Column:
    return F.round(F.least(F.greatest(F.round(value, 9), F.lit(0.0)), F.lit(1.0)), 3)


def citation_accuracy(cited: DataFrame, key: str, expected: Column, n_expected: int, retrieved: Column) -> DataFrame:
    """``key, accuracy, correct``: 0.7 x share of expected values cited + 0.3 x share of citations that were retrieved; 0.6 is correct."""
    g = cited.groupBy(key).agg(F.count_distinct(expected).alias("e"), F.avg(retrieved.cast("int")).alias("r"))
    accuracy = _metric(0.7 * F.col("e") / n_expected + 0.3 * F.col("r"))
    return g.select(key, accuracy.alias("accuracy"), (accuracy >= 0.6).alias("correct"))


#: Values that must match: deductions, and the names of their notes.
DEDUCTIONS = {
    "empty_answer": 0.7, "legal_claim_without_retrieved_context": 0.45, "missing_citation_backed_wording": 0.2,
    "unsupported_law_title": 0.25, "unsupported_article": 0.15, "no_returned_citations": 0.15,
}


def faithfulness(
    answers: DataFrame, keys: list[str], answer: Column, context: Column, sources: Column, citations: Column, backing: str, no_info: str, title: str, article: str = r"[0-9]+(?:\.[0-9]+)*"
) -> DataFrame:
    """``keys, score, faithful, notes``: 1 less the ``DEDUCTIONS``; 0.7 is faithful.

    ``context`` is the retrieved text in normal form (lower case, single
    blanks), ``sources`` the number of retrieved texts, ``citations`` an array
    of cited titles and article numbers in normal form.  An answer is backed if
    there are citations and its wording matches ``backing`` or names one of
    them; ``no_info`` is the wording of an answer that claims nothing; the
    first ``title`` of more than five characters and the first ``article`` that
    the context lacks are noted with their text.
    """
    normal = collapse_space(F.lower(answer))
    some, cited = sources > 0, F.size(citations) > 0
    lacking = lambda pattern, least: F.get(F.filter(
        F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(0)), lambda x: collapse_space(F.lower(x))),
        lambda x: (F.length(x) > least) & ~F.contains(context, x),
    ), F.lit(0))
    backed = cited & (answer.rlike(backing) | F.exists(citations, lambda c: (c != "") & F.contains(normal, c)))
    rows = answers.select(*keys, normal.alias("__n"), answer.alias("__a"), some.alias("__some"), backed.alias("__backed"), cited.alias("__cited"), lacking(title, 5).alias("__t"), lacking(article, 0).alias("__x"))
    held = {
        "empty_answer": F.col("__n") == "",
        "legal_claim_without_retrieved_context": ~F.col("__some") & (F.col("__n") != "") & ~F.col("__a").rlike(no_info),
        "missing_citation_backed_wording": F.col("__some") & ~F.col("__backed"),
        "unsupported_law_title": F.col("__t").isNotNull(),
        "unsupported_article": F.col("__x").isNotNull(),
        "no_returned_citations": F.col("__some") & ~F.col("__cited"),
    }
    said = {"unsupported_law_title": F.concat(F.lit("unsupported_law_title:"), "__t"), "unsupported_article": F.concat(F.lit("unsupported_article:"), "__x")}
    score = _metric(1 - sum((c.cast("int") * DEDUCTIONS[name] for name, c in held.items()), F.lit(0.0)))
    notes = F.array_compact(F.array(*(F.when(c, said.get(name, F.lit(name))) for name, c in held.items())))
    text = F.when(F.size(notes) == 0, "ok").otherwise(F.array_join(notes, ","))
    return rows.select(*keys, score.alias("score"), (score >= 0.7).alias("faithful"), text.alias("notes"))


def run_summary(cases: DataFrame, keys: list[str], error: Column, rules: dict[str, Column], metrics: dict[str, Column]) -> DataFrame:
    """``keys, cases, completed, failed``, cases that break each of ``rules`` (conditions that should hold) and means of ``metrics`` over completed cases.

    A case fails by an error or by any rule; rules are counted on completed cases.
    """
    done = ~error
    broken = {name: done & ~F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    failed = error
    for c in broken.values():
        failed = failed | c
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(done).alias("completed"), F.count_if(failed).alias("failed"),
        *(F.count_if(c).alias(f"failed_{name}") for name, c in broken.items()),
        *(F.round(F.avg(F.when(done, value)), 4).alias(f"mean_{name}") for name, value in metrics.items()),
    )


def regression_gate(
    answers: DataFrame, keys: list[str], text: Column, must: Column, forbidden: Column, no_info: str, laws: Column, least_laws: Column, latency: Column, budget: Column, quality: dict[str, tuple[Column, Column]]
) -> DataFrame:
    """``keys, passed, issues``: an answer against what is expected of it.

    ``text`` in lower case; ``must`` and ``forbidden`` are arrays of wordings
    (one of the first must stand in it, none of the second may); an answer that
    has nothing to say (``no_info``) although laws are expected is an issue, as
    are fewer laws than expected, a latency over budget, and a quality value
    below its threshold (``name -> (value, threshold)``).
    """
    held = lambda words: F.exists(words, lambda w: F.contains(text, w))
    issues = F.array_compact(F.array(
        F.when((F.size(must) > 0) & ~held(must), "must_contain"), F.when(held(forbidden), "forbidden"),
        F.when(text.rlike(no_info) & (least_laws > 0), "no_info"), F.when(laws < least_laws, "too_few_laws"), F.when(latency > budget, "latency"),
        *(F.when(value < threshold, name) for name, (value, threshold) in quality.items()),
    ))
    return answers.select(*keys, issues.alias("__i")).select(*keys, (F.size("__i") == 0).alias("passed"), F.array_join("__i", ",").alias("issues"))


def latency_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, nearest-rank median and 95th percentile, and maximum of the valid values, in whole milliseconds.

    The percentile keeps one counter for each distinct value of a key, combined
    before the shuffle.
    """
    valid = rows.filter(F.col(value) >= 0)
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    whole = {"mean_ms": F.avg(value), "p50_ms": disc(0.5), "p95_ms": disc(0.95), "max_ms": F.max(value)}
    return valid.groupBy(*keys).agg(*(F.round(c).alias(n) for n, c in whole.items()))


def answer_quality(answers: DataFrame, keys: list[str], text: Column, retrieval: Column, citation: Column, latency: Column, budget: int, leaks: list[str]) -> DataFrame:
    """``keys, overall, issues``: 0.3 retrieval + 0.25 citation + 0.3 faithfulness + 0.15 latency, on an answer in normal form."""
    short = F.length(text) < 80
    leaking = sum((F.contains(text, F.lit(w)).cast("int") for w in leaks), F.lit(0)) > 0
    speed = F.when(latency <= budget, 1.0).otherwise(F.lit(float(budget)) / latency)
    faith = 1 - 0.35 * short.cast("int") - 0.25 * leaking.cast("int")
    issues = F.array_compact(F.array(
        F.when(short, "answer_too_short"), F.when(leaking, "internal_word_leak"), F.when(citation < 0.6, "no_citations"), F.when(speed < 1, "latency_budget_exceeded"),
    ))
    overall = _metric(retrieval * 0.3 + citation * 0.25 + faith * 0.3 + speed * 0.15)
    return answers.select(*keys, overall.alias("overall"), F.array_join(issues, ",").alias("issues"))

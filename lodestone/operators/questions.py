"""Batch classification of questions; lexicons are small literal tables given by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.retrieve import words


def keyword_profile(text: Column, stop: list[str], suffixes: str, most: int = 18) -> Column:
    """Distinct stems of at least two characters that are no stop words, in order, the first ``most``."""
    stems = F.transform(words(text), lambda w: F.regexp_replace(w, suffixes, ""))
    return F.slice(F.array_distinct(F.filter(stems, lambda w: (F.length(w) >= 2) & ~w.isin(*stop))), 1, most)


def lexicon_hits(text: Column, terms: list[str]) -> Column:
    """How many terms the text contains: whole words up to three characters, substrings beyond."""
    own, low = words(text), F.lower(text)
    held = [F.array_contains(own, t) if len(t) <= 3 else F.contains(low, F.lit(t)) for t in terms]
    return sum((h.cast("int") for h in held), F.lit(0))


def best_domain(scores: dict[str, Column], floor: int = 1, default: str = "unknown") -> Column:
    """Domain of the highest score, the first of equals; ``default`` below the floor."""
    top = F.greatest(*scores.values(), F.lit(0))
    out = F.lit(default)
    for name, score in reversed(scores.items()):
        out = F.when(score == top, name).otherwise(out)
    return F.when(top < floor, default).otherwise(out)


def _begins(part: str, gap: int):
    return lambda w: (F.abs(F.length(w) - len(part)) <= gap) & (F.startswith(w, F.lit(part)) | F.startswith(F.lit(part), w))


def loose_match(text: Column, keyword: str, gap: int = 3) -> Column:
    """Whether each word of the keyword begins, or is begun by, a word of the text at most ``gap`` characters longer or shorter."""
    own = words(text)
    found = F.lit(True)
    for part in keyword.split():
        near = F.exists(own, _begins(part, gap))
        found = found & near
    return found


def expansions(text: Column, rules: list[tuple[str, list[str]]], most: int) -> Column:
    """The question and the expansions of the rules whose marker it contains, distinct, in order, the first ``most``."""
    low = F.lower(text)
    parts = [F.array(text)] + [
        F.when(F.contains(low, F.lit(marker)), F.array(*(F.concat(text, F.lit(" " + x)) for x in extra))).otherwise(F.array().cast("array<string>"))
        for marker, extra in rules
    ]
    return F.slice(F.array_distinct(F.concat(*parts)), 1, most)


def overlap_with_history(turns: DataFrame, text: str, last: int = 8) -> DataFrame:
    """Turns with ``shared``: distinct words of four characters or more that also stand in the ``last`` turns before."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last, -1)
    long_words = F.array_distinct(F.filter(words(F.col(text)), lambda w: F.length(w) >= 4))
    rows = turns.withColumn("__w", long_words).withColumn("__h", F.flatten(F.collect_list("__w").over(before)))
    return rows.withColumn("shared", F.size(F.array_intersect("__w", "__h"))).drop("__w", "__h")


def ordered_label(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first rule (label, pattern) whose pattern the text matches."""
    out = F.lit(default).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def intent(text: Column, overrides: list[tuple[str, str]], keywords: list[tuple[str, str]], default: str = "unknown") -> Column:
    """Intent of a question: the first override whose pattern matches, else the first keyword that matches loosely in all its words."""
    out = F.lit(default)
    for label, keyword in reversed(keywords):
        out = F.when(loose_match(text, keyword), label).otherwise(out)
    return F.coalesce(ordered_label(text, overrides), out)


def scope(text: Column, weighted: list[tuple[int, list[str]]], greetings: list[str], least: int = 2, short: int = 30) -> tuple[Column, Column]:
    """(scope, score): ``in_scope`` from a weighted sum of lexicon hits on, ``greeting`` for a short text or one with a greeting and no hit, else ``out_of_scope``."""
    score = sum((w * lexicon_hits(text, terms) for w, terms in weighted), F.lit(0))
    greets = (lexicon_hits(text, greetings) > 0) & (score == 0)
    return F.when(score >= least, "in_scope").when((F.length(text) < short) | greets, "greeting").otherwise("out_of_scope"), score


def settings(text: Column, speed: Column, scenario: Column, sizes: list[tuple[str, int, int, int]], fast: float = 0.5, capped: int = 16) -> Column:
    """``struct(mode, vector_k, keyword_k)``: limits by length class (name, characters from which on, limits; longest first), halved in fast mode, capped for a named scenario."""
    out = None
    for name, least, vector_k, keyword_k in reversed(sizes):
        scaled = [F.when(speed == "fast", F.lit(int(k * fast))).otherwise(k) for k in (vector_k, keyword_k)]
        bounded = [F.when(scenario.isNotNull(), F.least(k, F.lit(capped))).otherwise(k) for k in scaled]
        own = F.struct(F.lit(name).alias("mode"), bounded[0].alias("vector_k"), bounded[1].alias("keyword_k"))
        out = own if out is None else F.when(F.length(text) > least, own).otherwise(out)
    return out


def history_choice(turns: DataFrame, topic, follow: str, last: int = 8, keep: int = 6, overlap: int = 2) -> DataFrame:
    """User turns with ``shared, follow_up, kept``: how many turns before one are passed on with it.

    Of the ``last`` turns before, the user's are the history.  A question that
    begins like a follow-up (``follow``), or shares ``overlap`` long words with
    the history, takes the latest ``keep`` turns; one with another known
    ``topic`` (a function of text) than the history takes none, unless it
    begins like a follow-up.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last, -1)
    said = F.when(F.col("role") == "user", F.col("text"))
    rows = turns.withColumns({"__n": F.count(F.lit(1)).over(before), "__h": F.array_join(F.collect_list(said).over(before), " ")}).filter("role = 'user'")
    long = lambda text: F.array_distinct(F.filter(words(text), lambda w: F.length(w) >= 4))
    rows = rows.withColumns({
        "shared": F.size(F.array_intersect(long(F.col("text")), long(F.col("__h")))).cast("long"), "follow_up": F.col("text").rlike(follow),
        "__t": topic(F.col("text")), "__u": topic(F.col("__h")),
    })
    other = (F.col("__t") != "unknown") & (F.col("__u") != "unknown") & (F.col("__t") != F.col("__u"))
    taken = F.least(F.col("__n"), F.lit(keep))
    kept = F.when(F.col("follow_up"), taken).when(other, 0).when(F.col("shared") >= overlap, taken).otherwise(0)
    return rows.select("conv_id", "turn", "shared", "follow_up", kept.cast("long").alias("kept"))


def opposed(a: Column, b: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whether two topics are one of the incompatible pairs, either way round; false for null."""
    held = F.lit(False)
    for x, y in pairs:
        held = held | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return F.coalesce(held, F.lit(False))


def carry_forward(had: Column, topic: Column, before: Column, follow: Column, clarify: Column, n_words: Column, shared: Column, pairs: list[tuple[str, str]]) -> Column:
    """``struct(carry, kept)``: what becomes of the ``had`` hits of the turn before.

    In this order: none (or null) gives ``refresh``; an incompatible topic in a
    question of three words or more that is no follow-up gives ``refresh``; a
    clarifying question or a follow-up gives ``reuse`` of the better half, two
    at least; another known topic in four words or more gives ``refresh``; the
    same topic with a shared word gives ``reuse`` of all; else ``refresh``.
    """
    n = F.coalesce(had, F.lit(0)).cast("long")
    label = lambda name, kept: F.struct(F.lit(name).alias("carry"), kept.cast("long").alias("kept"))
    none = label("refresh", F.lit(0))
    half = F.least(n, F.greatest(F.lit(2), F.ceil(n / 2)))
    fresh = (topic != "unknown") & (before != "unknown") & (topic != before) & (n_words >= 4)
    return (
        F.when(n == 0, none)
        .when(opposed(topic, before, pairs) & (n_words >= 3) & ~follow, none)
        .when(clarify | follow, label("reuse", half))
        .when(F.coalesce(fresh, F.lit(False)), none)
        .when((topic == before) & (shared > 0), label("reuse", n))
        .otherwise(none)
    )


def known_before(turns: DataFrame, ids: Column) -> DataFrame:
    """``conv_id, turn, known``: how many distinct ids stood in the turns before one.

    Counted from the first turn of each id, so that no turn gathers its history.
    """
    first = turns.select("conv_id", "turn", F.explode(F.array_distinct(ids)).alias("id")).groupBy("conv_id", "id").agg(F.min("turn").alias("turn"))
    new = first.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("new"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.join(new, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce(F.sum("new").over(before), F.lit(0)).alias("known"))

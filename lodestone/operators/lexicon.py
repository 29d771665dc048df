"""Lexicons as tables: all their terms are found in one pass over each text.

A lexicon has a row for each term.  Its terms make one Aho-Corasick automaton a
block, which tasks run over texts: the work follows the texts and the hits, not
the number of terms, and only (document, entry, count) leaves the pass.  Blocks
are bounded in bytes; a larger lexicon takes a pass more for each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.parse import all_matches, article_numbers, law_ids
from lodestone.operators.retrieve import words
from lodestone.operators.rows import top_k

#: Bytes of the terms that one automaton holds; an automaton takes some ten times as much.
BLOCK_BYTES = 8 << 20
#: Longest term that counts as a whole word only, where a lexicon does not say how its terms match.
SHORT = 3
#: A value that must match: case numbers have six digits.
LEAST_CASE = 100_000


def _automaton(rows: Iterable[tuple[int, str, str]]) -> ahocorasick.Automaton:
    held: dict[str, list[tuple[int, str]]] = {}
    for entry, term, how in rows:
        held.setdefault(term, []).append((entry, how))
    found = ahocorasick.Automaton()
    for term, entries in held.items():
        found.add_word(term, (len(term), entries))
    found.make_automaton()
    return found


def hits(text: str, automaton: ahocorasick.Automaton) -> Counter:
    """Places of each entry: anywhere (``part``), at the start of a word (``prefix``), or a word of its own (``word``)."""
    out: Counter = Counter()
    for end, (size, entries) in automaton.iter(text):
        begins = end < size or not text[end - size].isalnum()
        ends = end + 1 == len(text) or not text[end + 1].isalnum()
        for entry, how in entries:
            if how == "part" or (begins and (how == "prefix" or ends)):
                out[entry] += 1
    return out


def _normal(lexicon: DataFrame) -> DataFrame:
    """``entry, term, how`` in lower case; a term that does not say how it matches is a word up to ``SHORT`` letters or figures, else a part."""
    how = F.col("how") if "how" in lexicon.columns else F.lit(None).cast("string")
    low = F.btrim(F.lower("term"))
    natural = F.when(low.rlike(rf"^[\p{{L}}\p{{N}}]{{1,{SHORT}}}$"), "word").otherwise("part")
    return lexicon.select(F.col("entry").cast("long").alias("entry"), low.alias("term"), F.coalesce(how, natural).alias("how")).filter("term <> ''").distinct()


def scan(docs: DataFrame, lexicon: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int | None = None) -> DataFrame:
    """``<doc_id>, entry, n``: the entries of ``lexicon(entry, term[, how])`` that a text holds, in any case, and at how many places.

    Null and empty texts and blank terms hold nothing; of equal rows of the
    lexicon one counts, entries that share a term count each.
    """
    spark, rows, out = docs.sparkSession, _normal(lexicon), None
    size = rows.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = -(-size // (block_bytes or BLOCK_BYTES))
    for no in range(blocks):
        block = [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("entry", "term"), F.lit(blocks)) == no).collect()]
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared.value) if shared.value else None
            for batch in batches:
                at, entries, counts = [], [], []
                for i, t in enumerate(batch.column(1)):
                    found = hits(t.as_py() or "", automaton) if automaton is not None else {}
                    at += [i] * len(found)
                    entries += found.keys()
                    counts += found.values()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(entries, pa.int64()), pa.array(counts, pa.int64())], names=[doc_id, "entry", "n"])

        kind = docs.schema[doc_id].dataType.simpleString()
        part = docs.select(doc_id, F.lower(text).alias(text)).mapInArrow(run, f"`{doc_id}` {kind}, entry bigint, n bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.select(doc_id, F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("n")).limit(0)
    return out


def group_scores(docs: DataFrame, lexicon: DataFrame, group: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``<doc_id>, <group>, score``: how many distinct terms of each group of the lexicon a text holds."""
    numbered = lexicon.select(F.xxhash64(group, F.lower("term")).alias("entry"), "term", group, *(["how"] if "how" in lexicon.columns else []))
    names = numbered.select("entry", group).distinct()
    return scan(docs, numbered, doc_id, text).join(names, "entry").groupBy(doc_id, group).agg(F.count_distinct("entry").alias("score"))


def best_group(scores: DataFrame, group: str, doc_id: str = "doc_id", floor: int = 1) -> DataFrame:
    """The group of the highest score for each text, the smallest of equals, from ``floor`` on."""
    return top_k(scores.filter(F.col("score") >= floor), [doc_id], [F.desc("score"), F.col(group)], 1).drop("rank")


def stem_matches(stems: DataFrame, lexicon: DataFrame, suffixes: str, doc_id: str = "doc_id") -> DataFrame:
    """``<doc_id>, entry``: entries all of whose words' stems are among the ``stems`` (an array) of a text."""
    cut = F.array_distinct(F.filter(F.transform(words(F.col("term")), lambda w: F.regexp_replace(w, suffixes, "")), lambda w: F.length(w) >= 2))
    wanted = lexicon.select("entry", cut.alias("own")).select("entry", F.size("own").alias("needed"), F.explode("own").alias("stem"))
    held = stems.select(doc_id, F.explode(F.array_distinct("stems")).alias("stem"))
    return held.join(wanted, "stem").groupBy(doc_id, "entry").agg(F.count(F.lit(1)).alias("met"), F.first("needed").alias("needed")).filter("met = needed").select(doc_id, "entry")


def keyword_profile(questions: DataFrame, lexicon: DataFrame, stop: list[str], suffixes: str, article: str, key: str = "query_id", text: str = "text", topical: int = 18, led_by: int = 8) -> DataFrame:
    """A question's profile: ``<key>, stems, topical, phrases, hints, articles, expansions, domain, domain_score, signal_score``.

    ``lexicon(entry, kind, term, label)`` has phrases (found by ``term``, named
    ``label``), title hints, signal terms, and a kind ``domain`` whose label is
    the domain; a domain's term also counts if all its stems are the question's.
    ``article`` has the number in its first group.  Expansions are the phrases,
    hints, articles and the first ``led_by`` topical terms; signals count once,
    phrases once, hints twice.
    """
    own = F.transform(words(F.col(text)), lambda w: F.regexp_replace(w, suffixes, ""))
    rows = questions.select(key, text, F.array_distinct(F.filter(own, lambda w: (F.length(w) >= 2) & ~w.isin(*stop))).alias("stems"))
    rows = rows.select(
        key, text, "stems", F.slice(F.filter("stems", lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$")), 1, topical).alias("topical"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(article), F.lit(1))).alias("articles"),
    )
    found = scan(questions, lexicon, key, text).select(key, "entry").unionByName(stem_matches(rows, lexicon.filter("kind = 'domain'"), suffixes, key)).distinct()
    about = found.join(lexicon.select("entry", "kind", "label"), "entry")
    labels = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("label")))).alias(f"{kind}s")
    sums = about.groupBy(key).agg(labels("phrase"), labels("hint"), F.count_if(F.col("kind") == "signal").alias("signals"))
    domains = about.filter("kind = 'domain'").groupBy(key, F.col("label").alias("domain")).agg(F.count(F.lit(1)).alias("score"))
    best = best_group(domains, "domain", key).withColumnRenamed("score", "domain_score")
    joined = rows.join(sums, key, "left").join(best, key, "left")
    none = F.array().cast("array<string>")
    joined = joined.withColumns({"phrases": F.coalesce("phrases", none), "hints": F.coalesce("hints", none)})
    line = F.array_join(F.slice("topical", 1, led_by), " ")
    wide = F.filter(F.array_distinct(F.concat("phrases", "hints", F.transform("articles", lambda a: F.concat(F.lit("article "), a)), F.array(line))), lambda x: F.length(F.btrim(x)) >= 3)
    return joined.select(
        key, "stems", "topical", "phrases", "hints", "articles", wide.alias("expansions"), F.coalesce("domain", F.lit("unknown")).alias("domain"), F.coalesce("domain_score", F.lit(0)).alias("domain_score"),
        (F.coalesce("signals", F.lit(0)) + F.size("phrases") + 2 * F.size("hints")).alias("signal_score"),
    )


def rule_hits(docs: DataFrame, rules: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``<doc_id>, rule, score``: the best score that a row has by each rule.

    ``rules(rule, kind, field, value, score)``: the text contains the value
    (``contains``), or a column equals it (``equals``, flags as ``true``) or
    begins with it (``prefix``).  Columns meet rules by equality, prefixes by
    their lengths.
    """
    numbered = rules.withColumn("entry", F.xxhash64("rule", "kind", "field", "value"))
    out = scan(docs, numbered.filter("kind = 'contains'").select("entry", F.col("value").alias("term"), F.lit("part").alias("how")), doc_id, text).select(doc_id, "entry")
    plain = numbered.filter("kind <> 'contains'")
    shapes = plain.select("field", "kind", F.when(F.col("kind") == "prefix", F.length("value")).alias("size")).distinct().collect()
    keys = [
        F.struct(F.lit(s["field"]).alias("field"), F.lit(s["kind"]).alias("kind"), (F.col(s["field"]).cast("string") if s["size"] is None else F.substring(F.col(s["field"]).cast("string"), 1, s["size"])).alias("value"))
        for s in sorted(shapes, key=str)
    ]
    if keys:
        met = docs.select(doc_id, F.explode(F.array(*keys)).alias("k")).select(doc_id, "k.*").join(plain.select("field", "kind", "value", "entry"), ["field", "kind", "value"])
        out = out.unionByName(met.select(doc_id, "entry"))
    return out.join(numbered.select("entry", "rule", "score"), "entry").groupBy(doc_id, "rule").agg(F.max("score").alias("score"))


def rule_search(docs: DataFrame, rules: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``rule, <doc_id>, score, rank``: the k best rows of each rule; of equal scores the shorter text, then the smaller id."""
    scored = rule_hits(docs, rules, doc_id, text).join(docs.select(doc_id, F.length(text).alias("chars")), doc_id)
    return top_k(scored, ["rule"], [F.desc("score"), F.col("chars"), F.col(doc_id)], k).select("rule", doc_id, "score", "rank")


def scenarios(docs: DataFrame, rules: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``scenario, <doc_id>, met``: rows that suit a scenario.

    ``rules(scenario, part, term, fewest)``: at least ``fewest`` distinct terms
    of part ``need`` stand in the text and none of part ``veto``.
    """
    numbered = rules.withColumn("entry", F.xxhash64("scenario", "part", "term"))
    found = scan(docs, numbered.select("entry", "term", F.lit("part").alias("how")), doc_id, text).join(numbered.drop("term"), "entry")
    counted = found.groupBy("scenario", doc_id).agg(F.count_if(F.col("part") == "need").alias("met"), F.count_if(F.col("part") == "veto").alias("vetoes"))
    floors = numbered.filter("part = 'need'").groupBy("scenario").agg(F.max("fewest").alias("fewest"))
    return counted.join(floors, "scenario").filter("met >= fewest and vetoes = 0").select("scenario", doc_id, "met")



def legal_references(docs: DataFrame, lexicon: DataFrame, doc_id: str, text: str, case_word: str, courts: str, article_word: str = "article") -> DataFrame:
    """``<doc_id>, laws, articles, cases, courts, keywords``: what a text refers to, each once.

    Case numbers follow ``case_word`` and "No" and have six digits; ``courts``
    has a court's name in its first group; keywords are the terms of
    ``lexicon(entry, term[, how])``.  No text is shuffled.
    """
    t = F.col(text)
    cases = F.filter(all_matches(t, rf"(?i){case_word}\s+No\s*([0-9]{{5,6}})"), lambda x: x.cast("int") >= LEAST_CASE)
    names = F.filter(F.transform(all_matches(t, courts), lambda x: F.btrim(x)), lambda x: F.length(x).between(4, 99))
    plain = docs.select(doc_id, law_ids(t).alias("laws"), article_numbers(t, article_word).alias("articles"), F.array_distinct(cases).alias("cases"), F.array_distinct(names).alias("courts"))
    found = scan(docs, lexicon, doc_id, text).join(lexicon.select("entry", "term"), "entry").groupBy(doc_id).agg(F.collect_set("term").alias("keywords"))
    return plain.join(found, doc_id, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))

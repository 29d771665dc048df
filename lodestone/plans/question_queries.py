"""Question understanding over the turns of conversations and the benchmark passages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.parse import all_matches
from lodestone.operators import lexicon as lx
from lodestone.operators import quality
from lodestone.operators import questions as qs
from lodestone.operators.fuse import occurrences
from lodestone.operators.retrieve import words
from lodestone.operators.rows import first_per_key, top_k
from lodestone.plans.registry import query, table
from lodestone.plans.search_queries import HITS, WORDS_SQL, hits, with_text

STOP = ["the", "and", "les", "der", "die", "que", "los", "of", "de"]
SUFFIX = "(ing|tion|heit|ment)$"
DOMAINS = {"north": ["heit", "keit", "die", "und"], "south": ["ción", "mente", "los", "que"], "west": ["eaux", "elle", "les", "et"], "island": ["ingth", "tion", "the", "of"]}
W = WORDS_SQL.format("text")


def _users(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")


@query(f"""SELECT item_id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 18), ' ') AS profile FROM (SELECT item_id,
list_filter(list_transform({W}, lambda w: regexp_replace(w, '{SUFFIX}', '')), lambda w: length(w) >= 2 AND NOT list_contains({STOP}, w)) AS l FROM benchmark)""")
def que_1_profile(spark, sf_dir):
    profile = qs.keyword_profile(F.col("text"), STOP, SUFFIX)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(profile, " ").alias("profile"))


def _score_sql(terms):
    return " + ".join(f"list_contains({W}, '{t}')::INT" if len(t) <= 3 else f"contains(lower(text), '{t}')::INT" for t in terms)


_SCORES = ", ".join(f"{_score_sql(t)} AS {d}" for d, t in DOMAINS.items())
_TOP = f"greatest({', '.join(DOMAINS)}, 0)"
_DOMAIN = f"CASE WHEN {_TOP} < {{0}} THEN 'unknown' {' '.join(f"WHEN {d} = {_TOP} THEN '{d}'" for d in DOMAINS)} END"


def _scores(text):
    return {d: qs.lexicon_hits(text, terms) for d, terms in DOMAINS.items()}


@query(f"SELECT doc_id, {', '.join(DOMAINS)}, {_DOMAIN.format(1)} AS best FROM (SELECT doc_id, {_SCORES} FROM documents)")
def que_2_lexicon_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", *(s.alias(d) for d, s in _scores(F.col("text")).items()))
    return rows.withColumn("best", qs.best_domain({d: F.col(d) for d in DOMAINS}))


#: Lexicon of the passages: each passage is a group, its distinct words of four letters or more its terms.
_LONG_WORDS = f"list_distinct(list_filter({W}, lambda w: length(w) >= 4))"
LEXICON_SQL = f"lexicon AS (SELECT item_id, unnest({_LONG_WORDS}) AS term FROM benchmark)"


def passage_lexicon(spark, sf_dir):
    terms = F.array_distinct(F.filter(words(F.col("text")), lambda w: F.length(w) >= 4))
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(terms).alias("term"))


@query(f"""WITH {LEXICON_SQL}, s AS (SELECT doc_id, item_id, count(*) AS score FROM (SELECT doc_id, lower(text) AS low FROM documents) JOIN lexicon ON contains(low, term) GROUP BY doc_id, item_id)
SELECT doc_id, arg_min(item_id, o) AS item_id, arg_min(score, o) AS score FROM (SELECT *, (-score)::HUGEINT * 1000000000 + item_id AS o FROM s) GROUP BY doc_id""")
def que_2_lexicon_table(spark, sf_dir):
    """The passage whose words a document holds most of; all words of all passages are looked for in one pass."""
    scores = lx.group_scores(table(spark, sf_dir, "documents"), passage_lexicon(spark, sf_dir), "item_id")
    return lx.best_group(scores, "item_id")


#: Terms of a profile: phrases and what they are called, titles, signals, and domains.
PROFILE = [
    ("phrase", "of the", "belonging"), ("phrase", "in der", "inside"), ("phrase", "de la", "origin"), ("hint", "license", "Licence act"), ("hint", "copyright", "Copyright act"), ("hint", "und", "Union act"),
    ("signal", "tion", "tion"), ("signal", "the", "the"), ("signal", "eau", "eau"), ("signal", "heit", "heit"), *(("domain", t, d) for d, ts in DOMAINS.items() for t in ts),
]
_PROFILE_VALUES = ", ".join(f"({i}, '{k}', '{t}', '{n}')" for i, (k, t, n) in enumerate(PROFILE))
ARTICLE_REF = r"(?i)(?:article|version)\s*([0-9]+(?:\.[0-9]+)*)"


def _ordered_distinct(l):
    return f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"


_STEMS = f"list_filter(list_transform({W}, lambda w: regexp_replace(w, '{SUFFIX}', '')), lambda w: length(w) >= 2 AND NOT list_contains({STOP}, w))"


@query(rf"""WITH lx AS (SELECT * FROM (VALUES {_PROFILE_VALUES}) AS v(entry, kind, term, label)),
q AS (SELECT item_id, text, lower(text) AS low, {W} AS ws, {_ordered_distinct(_STEMS)} AS stems FROM benchmark),
p AS (SELECT *, list_slice(list_filter(stems, lambda w: length(w) >= 3 AND NOT regexp_matches(w, '^[0-9]+$')), 1, 18) AS topical, {_ordered_distinct(f"regexp_extract_all(text, '{ARTICLE_REF}', 1)")} AS articles FROM q),
t AS (SELECT entry, list_distinct(list_filter(list_transform({WORDS_SQL.format("term")}, lambda w: regexp_replace(w, '{SUFFIX}', '')), lambda w: length(w) >= 2)) AS own FROM lx),
f AS (SELECT DISTINCT item_id, kind, label, lx.entry FROM p, lx JOIN t USING (entry) WHERE CASE WHEN regexp_matches(term, '^[\p{{L}}\p{{N}}]{{1,3}}$') THEN list_contains(ws, term) ELSE contains(low, term) END
  OR (kind = 'domain' AND len(own) > 0 AND len(list_filter(own, lambda w: list_contains(stems, w))) = len(own))),
a AS (SELECT item_id, list_sort(coalesce(list(DISTINCT label) FILTER (kind = 'phrase'), [])) AS phrases, list_sort(coalesce(list(DISTINCT label) FILTER (kind = 'hint'), [])) AS hints, count(*) FILTER (kind = 'signal') AS signals FROM f GROUP BY item_id),
d AS (SELECT item_id, label AS domain, n FROM (SELECT item_id, label, count(*) AS n FROM f WHERE kind = 'domain' GROUP BY item_id, label) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, label) = 1),
j AS (SELECT p.*, coalesce(phrases, []) AS phrases, coalesce(hints, []) AS hints, coalesce(signals, 0) AS signals, coalesce(domain, 'unknown') AS domain, coalesce(n, 0) AS domain_score FROM p LEFT JOIN a USING (item_id) LEFT JOIN d USING (item_id)),
x AS (SELECT *, list_concat(phrases, hints, list_transform(articles, lambda n: 'article ' || n), [array_to_string(list_slice(topical, 1, 8), ' ')]) AS wide FROM j)
SELECT item_id, array_to_string(topical, ' ') AS topical, array_to_string(phrases, '|') AS phrases, array_to_string(hints, '|') AS hints, array_to_string(articles, '|') AS articles,
array_to_string(list_filter({_ordered_distinct("wide")}, lambda e: length(trim(e)) >= 3), '|') AS expansions, domain, domain_score, signals + len(phrases) + 2 * len(hints) AS signal_score FROM x""")
def que_1_keyword_profile(spark, sf_dir):
    lexicon = spark.createDataFrame([(i, *row) for i, row in enumerate(PROFILE)], "entry long, kind string, term string, label string")
    found = lx.keyword_profile(table(spark, sf_dir, "benchmark"), lexicon, STOP, SUFFIX, ARTICLE_REF, key="item_id")
    text = lambda c, glue="|": F.array_join(c, glue).alias(c)
    return found.select("item_id", text("topical", " "), text("phrases"), text("hints"), text("articles"), text("expansions"), "domain", "domain_score", "signal_score")


@query(f"SELECT doc_id, {_DOMAIN.format(3)} AS domain FROM (SELECT doc_id, {_SCORES} FROM documents)")
def que_3_domain_with_floor(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", *(s.alias(d) for d, s in _scores(F.col("text")).items()))
    return rows.select("doc_id", qs.best_domain({d: F.col(d) for d in DOMAINS}, 3).alias("domain"))


INTENTS = [("refund", "erent then"), ("status", "heiten ein"), ("other_topic", "queque elle")]


def _loose_sql(keyword):
    return " AND ".join(f"len(list_filter({W}, lambda w: abs(length(w) - {len(p)}) <= 3 AND (starts_with(w, '{p}') OR starts_with('{p}', w)))) > 0" for p in keyword.split())


#: Patterns that come before any keyword.
OVERRIDES = [("listing", r"(?s)\n.*\n.*\n"), ("short", r"(?s)^.{0,39}$"), ("asked", r"^(?:Qu|Wer|Wh)[a-z]* ")]


def _label_sql(rules, default):
    return f"CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN '{label}'" for label, p in rules)} ELSE {default} END"


@query(f"""SELECT conv_id, turn, {_label_sql(OVERRIDES, "CASE " + " ".join(f"WHEN {_loose_sql(k)} THEN '{i}'" for i, k in INTENTS) + " ELSE 'unknown' END")} AS intent FROM conversations WHERE role = 'user'""")
def que_4_intent(spark, sf_dir):
    return _users(spark, sf_dir).select("conv_id", "turn", qs.intent(F.col("text"), OVERRIDES, INTENTS).alias("intent"))


GREETINGS = ["the", "der", "la"]


@query(f"""SELECT conv_id, turn, CASE WHEN s >= 2 THEN 'in_scope' WHEN length(text) < 30 OR (g > 0 AND s = 0) THEN 'greeting' ELSE 'out_of_scope' END AS scope, s
FROM (SELECT conv_id, turn, text, 2 * ({_score_sql(DOMAINS["north"])}) + ({_score_sql(DOMAINS["west"])}) AS s, {_score_sql(GREETINGS)} AS g FROM conversations WHERE role = 'user')""")
def que_5_scope(spark, sf_dir):
    label, score = qs.scope(F.col("text"), [(2, DOMAINS["north"]), (1, DOMAINS["west"])], GREETINGS)
    return _users(spark, sf_dir).select("conv_id", "turn", label.alias("scope"), score.alias("s"))


MODES = [("article", "(?i)^(?:the|le|das) "), ("document", r"\n")]
SCENARIOS = [("contract", "(?i)heit.*ung"), ("family", "(?i)eau.*tion"), ("court", "(?i)ment[.]")]


@query(rf"""SELECT conv_id, turn, {_label_sql(MODES, "'qa'")} AS mode, {_label_sql(SCENARIOS, "NULL")} AS scenario, regexp_matches(text, '^[^ ]+ [^ ]+ [^ ]+\.') AS broad FROM conversations WHERE role = 'user'""")
def que_6_mode(spark, sf_dir):
    text = F.col("text")
    return _users(spark, sf_dir).select(
        "conv_id", "turn", qs.ordered_label(text, MODES, "qa").alias("mode"), qs.ordered_label(text, SCENARIOS).alias("scenario"), text.rlike(r"^[^ ]+ [^ ]+ [^ ]+\.").alias("broad")
    )


RULES = [("heit", ["norm", "regel"]), ("tion", ["rule"]), ("eau", ["norme", "norm"])]


@query(f"""SELECT conv_id, turn, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 4), '|') AS queries FROM (SELECT conv_id, turn,
list_concat([text]{"".join(f", CASE WHEN contains(lower(text), '{m}') THEN [{', '.join(f"text || ' {x}'" for x in xs)}] ELSE [] END" for m, xs in RULES)}) AS l FROM conversations WHERE role = 'user')""")
def que_7_expansion(spark, sf_dir):
    return _users(spark, sf_dir).select("conv_id", "turn", F.array_join(qs.expansions(F.col("text"), RULES, 4), "|").alias("queries"))


SIZES = [("long", 250, 40, 12), ("normal", 120, 30, 24), ("short", 0, 20, 24)]


@query(f"""SELECT item_id, mode, {", ".join(f"CASE WHEN scenario IS NOT NULL THEN least({k}, 16) ELSE {k} END AS {k}" for k in ("vector_k", "keyword_k"))} FROM (SELECT item_id, mode, scenario,
{", ".join(f"CASE WHEN fast THEN CAST(floor({k} * 0.5) AS INT) ELSE {k} END AS {k}" for k in ("vector_k", "keyword_k"))} FROM (SELECT item_id, contains(text, chr(10)) AS fast, {_label_sql(SCENARIOS, "NULL")} AS scenario,
CASE WHEN length(text) > 250 THEN 'long' WHEN length(text) > 120 THEN 'normal' ELSE 'short' END AS mode FROM benchmark) JOIN (VALUES ('long', 40, 12), ('normal', 30, 24), ('short', 20, 24)) AS z(mode, vector_k, keyword_k) USING (mode))""")
def que_8_settings(spark, sf_dir):
    """A passage of several lines is asked in fast mode."""
    text = F.col("text")
    speed = F.when(F.contains(text, F.lit("\n")), "fast").otherwise("full")
    chosen = qs.settings(text, speed, qs.ordered_label(text, SCENARIOS), SIZES)
    return table(spark, sf_dir, "benchmark").select("item_id", chosen.alias("s")).select("item_id", "s.*")


FOLLOW, CLARIFY = r"^(?:Et|Le|The|Die|De) ", r"^[^ ]{1,3} "
OPPOSED = [("north", "south"), ("west", "island"), ("north", "west")]
_LONG = f"list_distinct(list_filter({W}, lambda w: length(w) >= 4))"


def _topic(text):
    return qs.best_domain(_scores(text))


@query(f"""WITH h AS (SELECT *, count(*) OVER w AS n, array_to_string(list_filter(list(CASE WHEN role = 'user' THEN text END) OVER w, lambda x: x IS NOT NULL), ' ') AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
own AS (SELECT conv_id, turn, n, regexp_matches(text, '{FOLLOW}') AS follow_up, {_LONG} AS words, {_DOMAIN.format(1)} AS topic FROM (SELECT *, {_SCORES} FROM h) WHERE role = 'user'),
past AS (SELECT conv_id, turn, {_LONG} AS words, {_DOMAIN.format(1)} AS topic FROM (SELECT *, {_SCORES} FROM (SELECT conv_id, turn, role, coalesce(h, '') AS text FROM h)) WHERE role = 'user'),
j AS (SELECT o.conv_id, o.turn, o.n, follow_up, len(list_intersect(o.words, p.words)) AS shared, o.topic <> 'unknown' AND p.topic <> 'unknown' AND o.topic <> p.topic AS other FROM own o JOIN past p USING (conv_id, turn))
SELECT conv_id, turn, shared, follow_up, CASE WHEN follow_up THEN least(n, 6) WHEN other THEN 0 WHEN shared >= 2 THEN least(n, 6) ELSE 0 END AS kept FROM j""")
def que_9_follow_up(spark, sf_dir):
    return qs.history_choice(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), _topic, FOLLOW)


def _opposed_sql(a, b):
    return "coalesce(" + " OR ".join(f"({a} = '{x}' AND {b} = '{y}') OR ({a} = '{y}' AND {b} = '{x}')" for x, y in OPPOSED) + ", false)"


@query(f"""WITH t AS (SELECT conv_id, turn, length(text) < 8 AND NOT regexp_matches(text, '[0-9]') AS ambiguous, {_label_sql(SCENARIOS, "'general'")} AS sub_intent, {_DOMAIN.format(1)} AS topic FROM (SELECT conv_id, turn, text, {_SCORES} FROM conversations WHERE role = 'user')),
l AS (SELECT *, lag(topic) OVER (PARTITION BY conv_id ORDER BY turn) AS past FROM t) SELECT conv_id, turn, ambiguous, sub_intent, topic, {_opposed_sql("topic", "past")} AS drift FROM l""")
def que_10_drift(spark, sf_dir):
    w, text = Window.partitionBy("conv_id").orderBy("turn"), F.col("text")
    ambiguous = (F.length(text) < 8) & ~text.rlike("[0-9]")
    rows = _users(spark, sf_dir).select("conv_id", "turn", ambiguous.alias("ambiguous"), qs.ordered_label(text, SCENARIOS, "general").alias("sub_intent"), _topic(text).alias("topic"))
    return rows.withColumn("drift", qs.opposed(F.col("topic"), F.lag("topic").over(w), OPPOSED))


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, {_LONG} AS words, len({W}) AS n_words, {_DOMAIN.format(1)} AS topic FROM (SELECT conv_id, turn, role, text, {_SCORES} FROM conversations)),
s AS (SELECT *, lag(topic) OVER w AS past, lag(words) OVER w AS had_words, regexp_matches(text, '{FOLLOW}') AS follow, regexp_matches(text, '{CLARIFY}') AS clarify FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT *, coalesce(len(list_filter(had_words, lambda x: length(x) >= 9)), 0) AS n, len(list_intersect(words, coalesce(had_words, []))) AS shared FROM s WHERE role = 'user'),
k AS (SELECT conv_id, turn, n, CASE WHEN n = 0 THEN 0 WHEN {_opposed_sql("topic", "past")} AND n_words >= 3 AND NOT follow THEN 0 WHEN clarify OR follow THEN least(n, greatest(2, (n + 1) // 2))
WHEN coalesce(topic <> 'unknown' AND past <> 'unknown' AND topic <> past AND n_words >= 4, false) THEN 0 WHEN topic = past AND shared > 0 THEN n ELSE 0 END AS kept FROM c)
SELECT conv_id, turn, CASE WHEN kept > 0 THEN 'reuse' ELSE 'refresh' END AS carry, CAST(kept AS BIGINT) AS kept FROM k""")
def que_11_carry_forward(spark, sf_dir):
    """The long words of the turn before stand for its hits."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = words(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", _topic(F.col("text")).alias("topic"), F.size(own).alias("n_words"), F.array_distinct(F.filter(own, lambda x: F.length(x) >= 4)).alias("words"))
    rows = rows.withColumns({"past": F.lag("topic").over(w), "had_words": F.lag("words").over(w)}).filter("role = 'user'")
    had = F.size(F.filter("had_words", lambda x: F.length(x) >= 9))
    shared = F.coalesce(F.size(F.array_intersect("words", "had_words")), F.lit(0))
    carried = qs.carry_forward(F.greatest(had, F.lit(0)), F.col("topic"), F.col("past"), F.col("text").rlike(FOLLOW), F.col("text").rlike(CLARIFY), F.col("n_words"), shared, OPPOSED)
    return rows.select("conv_id", "turn", carried.alias("c")).select("conv_id", "turn", "c.*")


TITLES = ["chkeit", "eaux", "mente"]


@query(rf"""WITH i AS (SELECT conv_id, turn, list_concat(regexp_extract_all(text, '([A-Z][a-z]{{5,}})', 1), list_filter({TITLES}, lambda t: contains(lower(text), t))) AS ids FROM conversations)
SELECT conv_id, turn, len(list_distinct(coalesce(flatten(list(ids) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []))) AS known FROM i""")
def que_12_ids_from_history(spark, sf_dir):
    """Ids by pattern, and the titles of a list that a turn names."""
    named = F.filter(F.array(*map(F.lit, TITLES)), lambda t: F.contains(F.lower("text"), t))
    return qs.known_before(table(spark, sf_dir, "conversations"), F.concat(all_matches(F.col("text"), "([A-Z][a-z]{5,})"), named))


@query(f"""WITH {HITS}, d AS (SELECT query_id, id, rank, string_split(text, 'The ') AS p FROM hits JOIN documents ON id = doc_id WHERE rank <= 5),
s AS (SELECT query_id, id, unnest(p) AS seg, generate_subscripts(p, 1) AS i FROM d),
n AS (SELECT *, (length(seg) - length(replace(lower(seg), 'tion', ''))) // 4 + (length(seg) - length(replace(lower(seg), 'ea', ''))) // 2 AS n FROM s)
SELECT query_id, id, i - 1 AS segment, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY n DESC, i) AS k FROM n) WHERE k = 1 AND n >= 2""")
def fus_13_aligned_segment(spark, sf_dir):
    rows = with_text(spark, sf_dir, hits(spark, sf_dir).filter("rank <= 5"))
    cut = rows.select("query_id", "id", F.posexplode(F.split("text", "The ", -1)).alias("segment", "seg"))
    low = F.lower("seg")
    n = occurrences(low, F.lit("tion")) + occurrences(low, F.lit("ea"))
    best = first_per_key(cut.select("query_id", "id", "segment", n.alias("n")), ["query_id", "id"], [F.desc("n"), F.col("segment")])
    return best.filter("n >= 2")


@query(r"""WITH a AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(text, '([A-Z][a-z]{4,})', 1)) AS named FROM conversations),
u AS (SELECT conv_id, w, count(*) AS n FROM (SELECT conv_id, unnest(named) AS w FROM a WHERE role <> 'assistant') GROUP BY conv_id, w),
t AS (SELECT conv_id, list(w) AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, w) AS k FROM u) WHERE k <= 4 GROUP BY conv_id)
SELECT a.conv_id, turn, len(named) - len(list_intersect(named, coalesce(allowed, []))) AS ungrounded FROM a LEFT JOIN t USING (conv_id) WHERE role = 'assistant'""")
def res_9_grounding(spark, sf_dir):
    named = F.array_distinct(all_matches(F.col("text"), "([A-Z][a-z]{4,})"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", named.alias("named"))
    counts = rows.filter("role <> 'assistant'").select("conv_id", F.explode("named").alias("w")).groupBy("conv_id", "w").agg(F.count(F.lit(1)).alias("n"))
    allowed = top_k(counts, ["conv_id"], [F.desc("n"), F.col("w")], 4, "k").groupBy("conv_id").agg(F.collect_list("w").alias("allowed"))
    joined = rows.filter("role = 'assistant'").join(allowed, "conv_id", "left")
    none = F.array().cast("array<string>")
    return joined.select("conv_id", "turn", F.size(F.array_except("named", F.coalesce("allowed", none))).cast("long").alias("ungrounded"))


_REFS_SQL = r"list_distinct(regexp_extract_all({0}, '[0-9]+(?:\.[0-9]+)+', 0))"


@query(f"""WITH {HITS}, h AS (SELECT query_id, greatest(score, 0.1) AS s, unnest({_REFS_SQL.format("text")}) AS article FROM hits JOIN documents ON id = doc_id WHERE rank <= 6),
u AS (SELECT query_id, article, round(sum(s), 9) AS s FROM h GROUP BY query_id, article), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, article) AS place FROM u),
a AS (SELECT query_id, string_agg(article, '|' ORDER BY place) AS allowed, list(article) AS l FROM k WHERE place <= 4 GROUP BY query_id),
q AS (SELECT doc_id AS query_id, {_REFS_SQL.format("text")} AS said FROM documents WHERE doc_id IN (SELECT query_id FROM hits))
SELECT query_id, coalesce(allowed, '') AS allowed, array_to_string(list_sort(list_filter(said, lambda x: NOT list_contains(coalesce(l, []), x))), '|') AS ungrounded FROM q LEFT JOIN a USING (query_id)""")
def res_9_allowed_articles(spark, sf_dir):
    """Numbers that the best hits of a question back, by their scores; documents that ask stand for answers, whose other numbers are flagged."""
    refs = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:\.[0-9]+)+"), F.lit(0)))
    found = hits(spark, sf_dir)
    allowed = quality.allowed_articles(with_text(spark, sf_dir, found), "query_id", refs, F.col("score"), F.col("rank"))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text").join(found.select("query_id").distinct(), "query_id", "left_semi")
    rows = quality.ungrounded(asked.select("query_id", refs.alias("refs")), "query_id", F.col("refs"), allowed)
    return rows.select("query_id", F.array_join("allowed", "|").alias("allowed"), F.array_join(F.array_sort("ungrounded"), "|").alias("ungrounded"))


@query(r"""SELECT conv_id, turn, len(string_split(text, chr(10))) AS sections, len(regexp_extract_all(text, '[.!?](?:\s|$)', 0)) AS sentences, array_to_string(list_filter([CASE WHEN len(string_split(text, chr(10))) < 2 THEN 'one_section' END,
CASE WHEN len(regexp_extract_all(text, '[.!?](?:\s|$)', 0)) < 3 THEN 'few_sentences' END, CASE WHEN length(text) > 2000 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS issues FROM conversations WHERE role = 'assistant'""")
def res_11_sections(spark, sf_dir):
    sections = F.size(F.split("text", "\n", -1))
    sentences = F.size(F.regexp_extract_all("text", F.lit(r"[.!?](?:\s|$)"), F.lit(0)))
    issues = F.array_compact(F.array(F.when(sections < 2, "one_section"), F.when(sentences < 3, "few_sentences"), F.when(F.length("text") > 2000, "too_long")))
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return rows.select("conv_id", "turn", sections.alias("sections"), sentences.alias("sentences"), F.array_join(issues, ",").alias("issues"))

"""Retrieval, fusion and result queries.

Vector questions are the embeddings whose id is divisible by 50, searched
against all; text questions are the whole benchmark passages.
``hits`` (top 20) come from whole vectors, ``other`` from their first 32
dimensions, which stands for a second, independent list.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.text import collapse_space, snippet
from lodestone.operators import boosts as bo
from lodestone.operators import fuse as fs
from lodestone.operators import lexicon as lx
from lodestone.operators import retrieve as rt
from lodestone.operators.rows import best_by_key, first_per_key, keep_unless_empty, ranked, top_k
from lodestone.plans.registry import query, stored, table
from lodestone.plans.report_queries import CHUNKS_SQL, chunks
from lodestone.plans.text_queries import sql_sentence


def _cos(a, b, dims=""):
    cut = lambda v: f"CAST({v}[1:32] AS DOUBLE[])" if dims else f"CAST({v} AS DOUBLE[])"
    return f"round(greatest(0, least(1, list_cosine_similarity({cut(a)}, {cut(b)}))), 6)"


def _list_sql(name, dims=""):
    return f"""{name} AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM (SELECT q.vec_id AS query_id, i.vec_id AS id, {_cos("q.embedding", "i.embedding", dims)} AS score FROM embeddings q, embeddings i WHERE q.vec_id % 50 = 0)) WHERE rank <= 20)"""


HITS, OTHER = _list_sql("hits"), _list_sql("other", "x")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def hits(spark, sf_dir, k=20, dims=None):
    items = _vectors(spark, sf_dir)
    return rt.vector_top_k(items.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), items, k, dims)


def labelled(spark, sf_dir, found):
    return found.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")


def with_text(spark, sf_dir, found):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return found.join(docs, "id")


@query(f"WITH {HITS} SELECT query_id, id, score, rank FROM hits")
def rtv_1_vector_top_k(spark, sf_dir):
    return hits(spark, sf_dir)


@query(f"WITH {HITS}, {OTHER} SELECT query_id, id, max(score) AS score FROM (SELECT * FROM hits UNION ALL SELECT * FROM other) GROUP BY query_id, id")
def rtv_3_merge_variants(spark, sf_dir):
    both = hits(spark, sf_dir).unionByName(hits(spark, sf_dir, dims=32))
    return best_by_key(both.select("query_id", "id", "score"), ["query_id", "id"], "score")


WORDS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+', 0)"


def _asked(name="asked", n=100_000):
    ws = WORDS_SQL.format("text")
    return f"""{name} AS (SELECT query_id, unnest(l) AS term, len(l) AS n_terms FROM (SELECT item_id AS query_id,
list_slice(list_filter({ws}, lambda x, i: list_position({ws}, x) = i), 1, {n}) AS l FROM benchmark))"""


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _top(body, k):
    return f"SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({body})) WHERE rank <= {k}"


FULL_SQL = rf"""{_asked()}, split AS (SELECT doc_id, regexp_extract(text, '^([^\n]*)', 1) AS title, text FROM documents),
w AS (SELECT doc_id, unnest({WORDS_SQL.format("title")}) AS term, 1.0::DOUBLE AS w FROM split UNION ALL SELECT doc_id, unnest({WORDS_SQL.format("substr(text, length(title) + 1)")}), 0.4::DOUBLE FROM split),
held AS (SELECT doc_id, term, sum(w) AS w FROM w WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM held GROUP BY term)"""
_FULL = """SELECT query_id, doc_id AS id, round(least(sum(idf * 2.2 * w / (w + 1.2)) / 10, 1), 6) AS score FROM {0} JOIN held USING (term) JOIN idf USING (term)
GROUP BY query_id, doc_id, n_terms HAVING count(*) = n_terms"""
FULL_HITS = _top(_FULL.format("asked"), 20)


@query(f"WITH {FULL_SQL} {FULL_HITS}")
def rtv_4_full_text(spark, sf_dir):
    return rt.full_text(_questions(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text", 20)


GRAMS_SQL = f"""list_distinct(flatten(list_transform({WORDS_SQL}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', CAST(i AS INT), 3)))))"""
#: Trigram search is over all chunks of all documents; the best chunk of a document counts.
TRIGRAM_SQL = rf"""{CHUNKS_SQL}, q AS (SELECT item_id AS query_id, lower(text) AS low, {GRAMS_SQL.format("text")} AS g FROM benchmark),
d AS (SELECT doc_id AS id, chunk_index, lower(text) AS text, {GRAMS_SQL.format("text")} AS g FROM chunks),
s AS (SELECT query_id, id, chunk_index, count(*) AS s, n, m FROM (SELECT query_id, len(g) AS n, unnest(g) AS x FROM q) JOIN (SELECT id, chunk_index, len(g) AS m, unnest(g) AS x FROM d) USING (x) GROUP BY query_id, id, chunk_index, n, m),
found AS (SELECT query_id, id, max(round(s / (n + m - s), 6)) AS score FROM s JOIN q USING (query_id) JOIN d USING (id, chunk_index) WHERE round(s / (n + m - s), 6) > 0.3 OR contains(d.text, q.low) GROUP BY query_id, id)"""


@query(f"WITH {TRIGRAM_SQL} " + _top("SELECT * FROM found", 20))
def rtv_5_trigram(spark, sf_dir):
    return rt.trigram_search(_questions(spark, sf_dir), chunks(spark, sf_dir), "doc_id", "text", 20)


_SPACED_SQL = "' ' || array_to_string(" + WORDS_SQL + ", '  ') || ' '"


@query(rf"""WITH q AS (SELECT item_id AS query_id, {_SPACED_SQL.format("text")} AS phrase FROM benchmark), d AS (SELECT doc_id AS id, {_SPACED_SQL.format("text")} AS whole FROM documents)
""" + _top("SELECT query_id, id, CAST((length(whole) - length(replace(whole, phrase, ''))) / length(phrase) AS BIGINT) AS score FROM q JOIN d ON contains(whole, phrase) WHERE trim(phrase) <> ''", 20))  # fmt: skip
def rtv_6_phrase(spark, sf_dir):
    return rt.phrase_search(_questions(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text", 20)


TF_SQL = f"{_asked('every')}, t AS (SELECT doc_id AS id, unnest({WORDS_SQL.format('text')}) AS term FROM documents)"
TF_HITS = _top("SELECT query_id, id, round(least(sum(length(term)) / 100, 1), 6) AS score FROM every JOIN t USING (term) WHERE length(term) > 2 GROUP BY query_id, id", 20)


@query(f"WITH {TF_SQL} {TF_HITS}")
def rtv_7_term_frequency(spark, sf_dir):
    return rt.term_frequency_search(_questions(spark, sf_dir), table(spark, sf_dir, "documents"), "doc_id", "text", 20)


_NUMBERS_SQL = r"regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)+', 0)"


@query(rf"""WITH m AS (SELECT doc_id AS id, source AS law, {_NUMBERS_SQL}[1] AS article, substr(text, 1, 60) AS head, unnest(list_distinct({_NUMBERS_SQL})) AS number FROM documents),
s AS (SELECT *, CASE WHEN article = number THEN 1.0 ELSE 0.6 END::DOUBLE AS score FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, id) AS place FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY number, law, article, head ORDER BY score DESC, id) AS copy FROM p WHERE place <= 10)
SELECT number, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, id) AS rank FROM c WHERE copy = 1) WHERE rank <= 5""")
def rtv_8_article_lookup(spark, sf_dir):
    """Every number that any document holds is asked for."""
    docs = table(spark, sf_dir, "documents")
    found = F.regexp_extract_all("text", F.lit(rt.NUMBER), F.lit(0))
    numbers = docs.select(F.explode(found).alias("number")).distinct()
    return rt.article_lookup(numbers, docs, F.get(found, F.lit(0)), F.col("source"), F.col("text"), F.col("doc_id"))


@query(rf"""WITH d AS (SELECT doc_id AS id, source AS law, {_NUMBERS_SQL}[1] AS article, substr(text, 1, 60) AS head, text, regexp_extract_all(text, '\b[0-9]+\b', 0) AS figures FROM documents WHERE regexp_matches(text, '[0-9]')),
n AS (SELECT DISTINCT unnest({_NUMBERS_SQL}) AS number FROM documents),
s AS (SELECT number, id, law, article, head, CASE WHEN article = number THEN 1.0 WHEN contains(text, number) THEN 0.6 ELSE 0.1 END::DOUBLE AS score FROM n, d
  WHERE article = number OR contains(text, number) OR len(list_filter(string_split(number, '.'), lambda p: NOT list_contains(figures, p))) = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, id) AS place FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY number, law, article, head ORDER BY score DESC, id) AS copy FROM p WHERE place <= 10)
SELECT number, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, id) AS rank FROM c WHERE copy = 1) WHERE rank <= 5""")
def rtv_8_article_search(spark, sf_dir):
    """Every number that any document holds is asked for: as article, anywhere in a text, or by its figures."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]"))
    found = F.regexp_extract_all("text", F.lit(rt.NUMBER), F.lit(0))
    numbers = docs.select(F.explode(found).alias("number")).distinct()
    return rt.article_search(numbers, docs, F.get(found, F.lit(0)), F.col("source"), F.col("text"), F.col("doc_id"))


@query("""SELECT p_partkey, p_name, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey WHERE contains(lower(p_name), 'red') GROUP BY p_partkey, p_name ORDER BY p_name, p_partkey LIMIT 100""")
def rtv_9_title_search(spark, sf_dir):
    named = table(spark, sf_dir, "part").filter(F.contains(F.lower("p_name"), F.lit("red"))).select("p_partkey", "p_name")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("c"))
    return named.join(counts, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("c", F.lit(0)).alias("n")).orderBy("p_name", "p_partkey").limit(100)


@query("""SELECT o_orderkey, l_linenumber, l_partkey, n FROM (SELECT o_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY o_orderkey) AS n,
row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE k <= 5""")
def rtv_10_detail(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").join(orders, "l_orderkey")
    w = Window.partitionBy("l_orderkey")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    counted = ranked(lines.withColumn("n", F.count(F.lit(1)).over(w)), ["l_orderkey"], order, "k").filter("k <= 5")
    return counted.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "n")


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'meta-' || lang END, ''), source) AS source, coalesce(q, -1) AS quality
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)""")
def rtv_11_overlay(spark, sf_dir):
    meta = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("meta-"), "lang"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.coalesce(F.nullif(meta, F.lit("")), "source").alias("source"), F.coalesce("q", F.lit(-1)).alias("quality")
    )


@query(f"""WITH {FULL_SQL}, p AS ({FULL_HITS}), {TF_SQL}, s AS ({TF_HITS}),
n AS (SELECT query_id, (SELECT count(*) FROM p WHERE p.query_id = q.query_id) AS np, (SELECT count(*) FROM s WHERE s.query_id = q.query_id) AS ns FROM (SELECT item_id AS query_id FROM benchmark) q)
SELECT p.* FROM p JOIN n USING (query_id) WHERE np >= 3 OR np >= ns UNION ALL SELECT s.* FROM s JOIN n USING (query_id) WHERE NOT (np >= 3 OR np >= ns)""")
def rtv_12_fallback(spark, sf_dir):
    return rt.fallback(stored(rtv_4_full_text(spark, sf_dir)), stored(rtv_7_term_frequency(spark, sf_dir)), 3)


MARKERS = [("licence", "license", 0.9), ("licence", "copyright", 0.7), ("language", "heit", 0.6), ("language", "eaux", 0.5), ("noise", "###", 0.8)]
_CASES = {r: ", ".join(f"CASE WHEN contains(lower(text), '{m}') THEN {s}::DOUBLE END" for x, m, s in MARKERS if x == r) for r, _, _ in MARKERS}


@query("SELECT rule, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY score DESC, chars, id) AS rank FROM (" + " UNION ALL ".join(
    f"SELECT '{r}' AS rule, doc_id AS id, greatest({c}) AS score, length(text) AS chars FROM documents" for r, c in _CASES.items()) + ") WHERE score IS NOT NULL) WHERE rank <= 25")
def rtv_13_rules(spark, sf_dir):
    return rt.rules_search(table(spark, sf_dir, "documents"), MARKERS, "text", "doc_id", 25)


#: Rules of a fallback search: name, kind, field, value, score.
RULES = [
    ("licence", "contains", "text", "license", 0.9), ("licence", "contains", "text", "copyright", 0.7), ("licence", "equals", "source", "src3", 0.2), ("language", "contains", "text", "heit", 0.6),
    ("language", "equals", "lang", "de", 0.55), ("language", "contains", "text", "eaux", 0.5), ("trusted", "equals", "good", "true", 0.8), ("trusted", "prefix", "source", "src1", 0.4), ("trusted", "prefix", "lang", "e", 0.1),
]
_RULE_VALUES = ", ".join(f"('{r}', '{k}', '{f}', '{v}', {s}::DOUBLE)" for r, k, f, v, s in RULES)


@query(f"""WITH r AS (SELECT * FROM (VALUES {_RULE_VALUES}) AS v(rule, kind, field, value, score)),
d AS (SELECT doc_id, lower(text) AS low, length(text) AS chars, MAP {{'source': source, 'lang': lang, 'good': CASE WHEN quality = 1 THEN 'true' WHEN quality = 0 THEN 'false' END}} AS f FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
h AS (SELECT rule, doc_id, chars, max(score) AS score FROM d JOIN r ON CASE kind WHEN 'contains' THEN contains(low, value) WHEN 'equals' THEN f[field] = value ELSE starts_with(f[field], value) END GROUP BY rule, doc_id, chars)
SELECT rule, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY score DESC, chars, doc_id) AS rank FROM h) WHERE rank <= 25""")
def rtv_13_rule_table(spark, sf_dir):
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    docs = table(spark, sf_dir, "documents").join(good, "doc_id", "left")
    rules = spark.createDataFrame(RULES, "rule string, kind string, field string, value string, score double")
    return lx.rule_search(docs, rules, 25)


@query(f"WITH {HITS}, {OTHER} SELECT query_id, id, max(score) AS score, max(source) AS source FROM (SELECT query_id, id, round(score * 0.9, 9) AS score, 'v' AS source FROM hits WHERE rank <= 10 UNION ALL SELECT query_id, id, round(score * 0.8, 9), 'v' FROM other) GROUP BY query_id, id")
def rtv_15_merge_fallback(spark, sf_dir):
    a = hits(spark, sf_dir).filter("rank <= 10").select("query_id", "id", F.round(F.col("score") * 0.9, 9).alias("score"))
    b = hits(spark, sf_dir, dims=32).select("query_id", "id", F.round(F.col("score") * 0.8, 9).alias("score"))
    return best_by_key(a.unionByName(b).withColumn("source", F.lit("v")), ["query_id", "id"], "score")


FOCUS = ("tion", "heit", "eau", "mente")


@query(f"""WITH {HITS}, n AS (SELECT query_id, id, {" + ".join(f"contains(text, '{t}')::INT" for t in FOCUS)} AS n, length(text) AS chars FROM hits JOIN documents ON id = doc_id WHERE rank <= 6)
SELECT query_id, id, round(least(0.72 + 0.08 * n, 0.97), 6)::DOUBLE AS score FROM n WHERE n > 0""")
def rtv_16_focused(spark, sf_dir):
    found = with_text(spark, sf_dir, hits(spark, sf_dir).filter("rank <= 6"))
    n = sum((F.contains("text", F.lit(t)).cast("int") for t in FOCUS), F.lit(0))
    return found.withColumn("n", n).filter("n > 0").select("query_id", "id", F.round(F.least(0.72 + 0.08 * F.col("n"), F.lit(0.97)), 6).alias("score"))


_FOCUS_SQL = f"list_slice(list_filter({WORDS_SQL.format('text')}, lambda w: length(w) >= 6), 1, 4)"


@query(f"""WITH {HITS}, {CHUNKS_SQL}, q AS (SELECT doc_id AS query_id, list_distinct({_FOCUS_SQL}) AS terms FROM documents),
n AS (SELECT h.query_id, c.doc_id, c.chunk_index, len(list_filter(terms, lambda t: contains(lower(c.text), t))) AS n FROM hits h JOIN chunks c ON h.id = c.doc_id JOIN q ON h.query_id = q.query_id WHERE h.rank <= 6),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id, chunk_index) AS place FROM n WHERE n > 0)
SELECT query_id, doc_id, chunk_index, round(least(0.72 + 0.08 * n, 0.97), 6)::DOUBLE AS score FROM k WHERE place <= 24""")
def rtv_16_focused_clauses(spark, sf_dir):
    """Chunks of the six documents best hit by a question that hold some of its first words of six letters."""
    terms = F.array_distinct(F.slice(F.filter(rt.words(F.col("text")), lambda w: F.length(w) >= 6), 1, 4))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), terms.alias("terms"))
    return rt.focused_clauses(hits(spark, sf_dir), chunks(spark, sf_dir), asked)


@query(f"""WITH {HITS} SELECT query_id, count(*) FILTER (label = 3 AND rank <= 10) AS preferred, count(*) FILTER (label = 3 AND rank <= 10) >= 1 AND max(score) >= 0.3 AS strong
FROM hits JOIN embeddings ON id = vec_id GROUP BY query_id""")
def rtv_17_coverage(spark, sf_dir):
    return rt.coverage(labelled(spark, sf_dir, hits(spark, sf_dir)), F.col("label") == 3, 10, 1, 0.3)


FUSED = f"""{HITS}, {OTHER}, fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM (
SELECT query_id, id, coalesce(h.score, 0)::DOUBLE AS vector_score, coalesce(o.score, 0)::DOUBLE AS keyword_score, round(coalesce(1 / (60 + h.rank), 0) + coalesce(1 / (60 + o.rank), 0), 9) AS rrf_score,
CASE WHEN h.rank IS NULL THEN 'keyword' WHEN o.rank IS NULL THEN 'vector' ELSE 'both' END AS source FROM hits h FULL JOIN other o USING (query_id, id)))"""


def fused(spark, sf_dir):
    return fs.reciprocal_rank_fusion(hits(spark, sf_dir), hits(spark, sf_dir, dims=32))


@query(f"WITH {FUSED} SELECT * FROM fused")
def fus_1_rrf(spark, sf_dir):
    return fused(spark, sf_dir)


@query(f"""WITH {FUSED}, m AS (SELECT query_id, round(avg(score), 6) AS mean FROM hits GROUP BY query_id)
SELECT query_id, id, round(CASE WHEN mean < 0.2 THEN greatest(keyword_score * 1.5, vector_score * 0.5, least(rrf_score * 15, 1)) WHEN mean < 0.5 THEN greatest(keyword_score * 1.3, vector_score, least(rrf_score * 12, 1))
ELSE greatest(vector_score * 1.1, keyword_score, least(rrf_score * 10, 1)) END, 9) AS score, round(greatest(vector_score, keyword_score, least(rrf_score * 10, 0.85)), 9) AS raw_score FROM fused JOIN m USING (query_id)""")
def fus_2_adaptive(spark, sf_dir):
    return fs.adaptive_score(fused(spark, sf_dir), hits(spark, sf_dir))


@query(f"WITH {HITS} SELECT query_id, min(score) AS lowest, max(score) AS highest, round(avg(score), 6) AS mean, list_sort(list(score))[count(*) // 2 + 1] AS median FROM hits GROUP BY query_id")
def fus_3_distribution(spark, sf_dir):
    return fs.score_distribution(hits(spark, sf_dir))


TERMS = ["the", "tion", "on", "ea"]


@query(f"""WITH {HITS}, c AS (SELECT query_id, id, score, rank, source, {" + ".join(f"(length(text) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in TERMS)} AS n,
{" + ".join(f"(length(text) - length(replace(lower(text), '{t}', ''))) // {len(t)}" for t in TERMS if t != "the")} AS s, count(*) OVER (PARTITION BY query_id) AS m FROM hits JOIN documents ON id = doc_id)
""" + _top("""SELECT query_id, id, round(greatest(0, least(1, CASE WHEN s = 0 THEN (score + least(n * 0.03, 0.35)) * 0.35 ELSE score + least(n * 0.03, 0.35) + least(s * 0.08, 0.35) END
+ 0.05 * (1 - (rank - 1) / m) + CASE WHEN source = 'src0' THEN 0.05 ELSE 0 END)), 6)::DOUBLE AS score FROM c""", 5))  # fmt: skip
def fus_4_heuristic_rerank(spark, sf_dir):
    rows = with_text(spark, sf_dir, hits(spark, sf_dir))
    terms = F.array(*(F.lit(t) for t in TERMS))
    return fs.heuristic_rerank(rows, terms, F.col("text"), F.col("source") == "src0", ["the"], 5)


_FOLD = lambda words, where: f"len(list_filter({words}, lambda w: contains({where}, w)))"
DOMAIN = ["tion", "heit", "able", "ment"]


@query(f"""WITH {HITS}, w AS (SELECT doc_id, source, text, list_distinct({WORDS_SQL.format("substr(text, 1, 120)")}) AS terms, list_distinct({WORDS_SQL.format("substr(text, 121, 120)")}) AS more,
lower(regexp_extract(text, '^([^\\n]*)', 1)) AS title, list_distinct({WORDS_SQL.format("substr(text, 601, 200)")}) AS kept FROM documents),
j AS (SELECT h.query_id, h.id, h.score, q.terms, list_filter(q.more, lambda x: NOT list_contains(q.terms, x)) AS more, q.source = d.source AS law, d.title, d.title || ' ' || lower(substr(d.text, 1, 1600)) AS corpus, d.kept
FROM hits h JOIN w d ON h.id = d.doc_id JOIN w q ON h.query_id = q.doc_id)
""" + _top(f"""SELECT query_id, id, round(least(1, score + least({_FOLD("terms", "corpus")}, 4) * 0.08 + least(1, {_FOLD("terms", "title")} / greatest(len(terms), 1)) * 0.2 + CASE WHEN law THEN 0.15 ELSE 0 END
+ least(1, {_FOLD(DOMAIN, "corpus")} / {len(DOMAIN)}) * 0.12 + least({_FOLD("more", "corpus")}, 1) * 0.15 + least(len(list_intersect(kept, terms)), 1) * 0.06), 6)::DOUBLE AS score FROM j""", 5))  # fmt: skip
def fus_5_hybrid_rerank(spark, sf_dir):
    """Questions are documents: their first words are terms, the next ones expansions; a hit of the same source stands for a named law."""
    docs = table(spark, sf_dir, "documents")
    cut = lambda first, n: F.array_distinct(rt.words(F.substring("text", first, n)))
    items = docs.select(F.col("doc_id").alias("id"), F.regexp_extract("text", r"^([^\n]*)", 1).alias("title"), F.col("text").alias("body"), cut(601, 200).alias("kept"), F.col("source").alias("law"))
    asked = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), cut(1, 120).alias("terms"), cut(121, 120).alias("more"), F.col("source").alias("asked_law"))
    rows = hits(spark, sf_dir).join(items, "id").join(asked, "query_id")
    domain = F.array(*map(F.lit, DOMAIN))
    return fs.hybrid_rerank(rows, F.col("terms"), F.col("title"), F.col("body"), 5, F.col("law") == F.col("asked_law"), domain, F.col("more"), F.col("kept"))


@query(f"""WITH {HITS}, {OTHER}, good AS (SELECT q.vec_id AS query_id, i.vec_id AS id FROM embeddings q JOIN embeddings i USING (label) WHERE q.vec_id % 50 = 0),
enough AS (SELECT query_id FROM hits JOIN good USING (query_id, id) WHERE rank <= 12 GROUP BY query_id HAVING count(*) >= 6),
raised AS (SELECT query_id, id, round(least(1, greatest(score + 0.1, 0.3)), 6)::DOUBLE AS score FROM other JOIN good USING (query_id, id) WHERE query_id NOT IN (SELECT query_id FROM enough))
SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM hits UNION ALL SELECT * FROM raised) GROUP BY query_id, id""")
def rtv_14_scenario_fallback(spark, sf_dir):
    """A hit suits the scenario if it has the question's label; the second list is what the set query finds."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    first, extra = stored(hits(spark, sf_dir)), stored(hits(spark, sf_dir, dims=32))
    pairs = first.select("query_id", "id").union(extra.select("query_id", "id")).distinct()
    relevant = labelled(spark, sf_dir, pairs).join(labels, "query_id").filter("label = wanted")
    return fs.scenario_fallback(first, extra, relevant, fewest=6, floor=0.3)


@query(f"""WITH {HITS} """ + _top("""SELECT query_id, id, round(least(score + CASE WHEN id % 3 = 0 THEN 0.1 ELSE 0 END + least(label * 0.05, 0.15), 1), 6)::DOUBLE AS score FROM hits JOIN embeddings ON id = vec_id
WHERE round(least(score + CASE WHEN id % 3 = 0 THEN 0.1 ELSE 0 END + least(label * 0.05, 0.15), 1), 6) >= 0.3""", 5))  # fmt: skip
def fus_7_reference_bonus(spark, sf_dir):
    rows = labelled(spark, sf_dir, hits(spark, sf_dir))
    score = fs.reference_bonus(F.col("score"), (F.col("id") % 3 == 0).cast("int"), F.col("label"))
    return top_k(rows.select("query_id", "id", F.round(score, 6).alias("score")).filter("score >= 0.3"), fs.QUERY, fs.best(), 5)


@query(f"WITH {HITS}, {OTHER} " + _top("SELECT query_id, id, max(score) AS score FROM (SELECT * FROM hits UNION ALL SELECT * FROM other) WHERE score >= 0.2 GROUP BY query_id, id", 15))
def fus_8_gate(spark, sf_dir):
    return fs.candidate_gate(hits(spark, sf_dir).unionByName(hits(spark, sf_dir, dims=32)), 0.2, 15)


@query(f"""WITH {HITS}, p AS (SELECT hits.*, label = 3 AND score > 0.2 AS pass FROM hits JOIN embeddings ON id = vec_id)
SELECT query_id, id, score, rank FROM (SELECT *, bool_or(pass) OVER (PARTITION BY query_id) AS anyone FROM p) WHERE pass OR NOT anyone""")
def fus_9_keep_unless_empty(spark, sf_dir):
    rows = labelled(spark, sf_dir, hits(spark, sf_dir))
    return keep_unless_empty(rows, fs.QUERY, (F.col("label") == 3) & (F.col("score") > 0.2)).select("query_id", "id", "score", "rank")


@query(f"WITH {HITS} SELECT query_id, id, round(least(score + 0.05, 1), 6)::DOUBLE AS score FROM hits JOIN embeddings ON id = vec_id WHERE label IN (1, 3) AND score >= 0.1")
def fus_10_hard_filter(spark, sf_dir):
    rows = labelled(spark, sf_dir, hits(spark, sf_dir)).filter(F.col("label").isin(1, 3) & (F.col("score") >= 0.1))
    return rows.select("query_id", "id", F.round(F.least(F.col("score") + 0.05, F.lit(1.0)), 6).alias("score"))


#: Scenario rules: name, patterns of which ``fewest`` must match, patterns of which none may.
SCENARIOS = [("german", ["heit", "ung", "und "], 2, ["###"]), ("french", ["eau", "les ", "eux"], 2, ["\\|"]), ("noise", ["###", "%%%", "!!", "\\|"], 1, [])]


@query(" UNION ALL ".join(f"""SELECT '{n}' AS scenario, doc_id FROM documents WHERE {" + ".join(f"regexp_matches(text, '{p}')::INT" for p in ps)} >= {k} {"".join(f" AND NOT regexp_matches(text, '{x}')" for x in no)}""" for n, ps, k, no in SCENARIOS))
def fus_11_scenarios(spark, sf_dir):
    text = F.col("text")
    held = [
        F.when((sum((text.rlike(p).cast("int") for p in ps), F.lit(0)) >= k) & ~(sum((text.rlike(x).cast("int") for x in no), F.lit(0)) > 0), n)
        for n, ps, k, no in SCENARIOS
    ]
    return table(spark, sf_dir, "documents").select(F.explode(F.array_compact(F.array(*held))).alias("scenario"), "doc_id")


#: Scenarios as rows: name, part, term, how many of the needed terms.
SCENARIO_RULES = [("german", "need", t, 2) for t in ("heit", "ung", "und ", "keit")] + [("german", "veto", "###", 2)] + [("french", "need", t, 3) for t in ("eau", "les ", "eux", "elle")] + [("french", "veto", t, 3) for t in ("|", "license")] + [("noise", "need", t, 1) for t in ("###", "%%%", "!!")]
_SCENARIO_VALUES = ", ".join(f"('{n}', '{p}', '{t}', {k})" for n, p, t, k in SCENARIO_RULES)


@query(f"""WITH r AS (SELECT * FROM (VALUES {_SCENARIO_VALUES}) AS v(scenario, part, term, fewest))
SELECT scenario, doc_id, count(*) FILTER (part = 'need') AS met FROM (SELECT doc_id, lower(text) AS low FROM documents) JOIN r ON contains(low, trim(lower(term))) GROUP BY scenario, doc_id
HAVING count(*) FILTER (part = 'need') >= max(fewest) AND count(*) FILTER (part = 'veto') = 0""")
def fus_11_scenario_table(spark, sf_dir):
    rules = spark.createDataFrame(SCENARIO_RULES, "scenario string, part string, term string, fewest int")
    return lx.scenarios(table(spark, sf_dir, "documents"), rules)


@query(f"""WITH {HITS} {_top("SELECT query_id, id, round(greatest(0, least(1, CASE WHEN label = 3 THEN score + 0.15 WHEN label IN (1, 2) THEN score * 0.72 WHEN id % 7 = 0 THEN score * 0.55 ELSE score END)), 6)::DOUBLE AS score FROM hits JOIN embeddings ON id = vec_id", 20)}""")
def fus_12_boosts(spark, sf_dir):
    s = F.col("score")
    boosted = F.when(F.col("label") == 3, s + 0.15).when(F.col("label").isin(1, 2), s * 0.72).when(F.col("id") % 7 == 0, s * 0.55).otherwise(s)
    rows = labelled(spark, sf_dir, hits(spark, sf_dir)).select("query_id", "id", F.round(fs.clamp(boosted), 6).alias("score"))
    return top_k(rows, fs.QUERY, fs.best(), 20)


@query(f"""WITH {HITS}, t AS (SELECT query_id, id, score, rank, label FROM hits JOIN embeddings ON id = vec_id),
n AS (SELECT *, count(*) FILTER (label % 2 = 0 AND rank <= 6) OVER (PARTITION BY query_id) AS even, count(*) FILTER (label % 2 = 1 AND rank <= 6) OVER (PARTITION BY query_id) AS odd FROM t)
{_top("SELECT query_id, id, round(CASE WHEN (label % 2 = 0) = (even >= odd) THEN least(score + 0.1, 1) ELSE score * 0.8 END, 6)::DOUBLE AS score FROM n", 6)}""")
def fus_14_track_rerank(spark, sf_dir):
    w = Window.partitionBy("query_id")
    near, even = F.col("rank") <= 6, F.col("label") % 2 == 0
    rows = labelled(spark, sf_dir, hits(spark, sf_dir)).withColumns({"e": F.count_if(near & even).over(w), "o": F.count_if(near & ~even).over(w)})
    agrees = even == (F.col("e") >= F.col("o"))
    score = F.when(agrees, F.least(F.col("score") + 0.1, F.lit(1.0))).otherwise(F.col("score") * 0.8)
    return top_k(rows.select("query_id", "id", F.round(score, 6).alias("score")), fs.QUERY, fs.best(), 6)


#: The texts of hits and of their questions (documents themselves), with a question's signal words: the different ones of its first eight of six letters or more.
_SIGNALS_SQL = f"list_distinct(list_slice(list_filter({WORDS_SQL.format('text')}, lambda w: length(w) >= 6), 1, 8))"
PAIR_SQL = f"""{HITS}, t AS (SELECT d.doc_id, d.lang, d.source, e.label, lower(regexp_extract(d.text, '^([^\\n]*)', 1)) AS title, lower(d.text) AS low, length(d.text) AS chars, {_SIGNALS_SQL.replace("text", "d.text")} AS signals FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
pairs AS (SELECT h.query_id, h.id, h.score, d.low, d.title, d.lang, d.label = q.label AS preferred, d.source = q.source AS canonical, q.chars > 2000 AS broad, len(q.signals) AS signals_asked, len(list_filter(q.signals, lambda w: contains(d.low, w))) AS n
  FROM hits h JOIN t d ON h.id = d.doc_id JOIN t q ON h.query_id = q.doc_id)"""


def question_pairs(spark, sf_dir):
    """Hits of the questions that are documents, as ``PAIR_SQL`` says."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    signals = F.array_distinct(F.slice(F.filter(rt.words(F.col("text")), lambda w: F.length(w) >= 6), 1, 8))
    t = table(spark, sf_dir, "documents").join(labels, "doc_id").select("doc_id", "lang", "source", "label", F.lower(F.regexp_extract("text", r"^([^\n]*)", 1)).alias("title"), F.lower("text").alias("low"), F.length("text").alias("chars"), signals.alias("signals"))
    asked = t.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("label").alias("q_label"), F.col("source").alias("q_source"), (F.col("chars") > 2000).alias("broad"), "signals")
    rows = hits(spark, sf_dir).join(t.drop("signals").withColumnRenamed("doc_id", "id"), "id").join(asked, "query_id")
    n = F.size(F.filter("signals", lambda w: F.contains(F.col("low"), w)))
    return rows.select("query_id", "id", "score", "low", "title", "lang", (F.col("label") == F.col("q_label")).alias("preferred"), (F.col("source") == F.col("q_source")).alias("canonical"), "broad", F.size("signals").alias("signals_asked"), n.alias("n"))


@query(f"""WITH {PAIR_SQL}, s1 AS (SELECT *, score + CASE WHEN preferred THEN 0.12 + broad::INT * 0.12 WHEN canonical THEN 0.06 + broad::INT * 0.06 ELSE 0 END + CASE WHEN broad AND lang = 'en' THEN 0.06 ELSE 0 END AS s FROM pairs),
s2 AS (SELECT *, s * CASE WHEN broad AND NOT preferred AND NOT canonical THEN 0.76 ELSE 1 END * CASE WHEN length(title) < 30 AND NOT preferred THEN CASE WHEN broad THEN 0.5 ELSE 0.72 END ELSE 1 END AS s2 FROM s1),
s3 AS (SELECT *, s2 + CASE WHEN contains(title, 'tion') THEN 0.18 ELSE 0 END + CASE WHEN contains(title, 'heit') THEN 0.12 ELSE 0 END AS s3 FROM s2),
s4 AS (SELECT *, CASE WHEN n > 0 THEN s3 + least(n * 0.05, 0.15) WHEN signals_asked > 0 THEN s3 * 0.72 ELSE s3 END * CASE WHEN contains(low, 'license') THEN 0.55 ELSE 1 END AS s4 FROM s3)
""" + _top("SELECT query_id, id, round(greatest(0, least(1, s4)), 6)::DOUBLE AS score FROM s4", 20))  # fmt: skip
def fus_12_rule_boosts(spark, sf_dir):
    rows = question_pairs(spark, sf_dir)
    preferred, canonical, broad, low = F.col("preferred"), F.col("canonical") & ~F.col("preferred"), F.col("broad"), (F.length("title") < 30) & ~F.col("preferred")
    seen = bo.evidence_of(
        preferred=preferred, broad_preferred=preferred & broad, canonical=canonical, broad_canonical=canonical & broad, broad_clause=broad & (F.col("lang") == "en"), broad_other=broad & ~preferred & ~F.col("canonical"),
        low_authority=low & ~broad, broad_low_authority=low & broad, topic_law=F.contains("title", F.lit("tion")), topic_article=F.contains("title", F.lit("heit")), signals=F.col("n"),
        no_signal=(F.col("signals_asked") > 0) & (F.col("n") == 0), boilerplate=F.contains("low", F.lit("license")),
    )
    scored = rows.select("query_id", "id", F.round(bo.folded(F.col("score"), seen, bo.BOOSTS), 6).alias("score"))
    return top_k(scored, fs.QUERY, fs.best(), 20)


#: Terms by which the track of a text is told.
TRACKS = {"a": ("heit", "keit", "schz", "eaux", "tzung"), "b": ("ción", "mente", "ingth", "tions", "elle")}
_TRACK_COUNT = lambda low, t: " + ".join(f"contains({low}, '{x}')::INT" for x in TRACKS[t])


@query(f"""WITH {PAIR_SQL}, c AS (SELECT p.*, q.low AS q_low, {_TRACK_COUNT("p.low", "a")} AS f, {_TRACK_COUNT("p.low", "b")} AS g, {_TRACK_COUNT("q.low", "a")} AS qf, {_TRACK_COUNT("q.low", "b")} AS qg FROM pairs p JOIN t q ON p.query_id = q.doc_id),
k AS (SELECT *, CASE WHEN f > g THEN 'a' WHEN g > f THEN 'b' ELSE 'unknown' END AS track, CASE WHEN qf > qg + 0.6 THEN 'a' WHEN qg > qf + 0.6 THEN 'b' ELSE 'neutral' END AS preference FROM c),
m AS (SELECT *, CASE preference WHEN 'a' THEN f WHEN 'b' THEN g ELSE 0 END AS mine, CASE preference WHEN 'a' THEN g WHEN 'b' THEN f ELSE 0 END AS other FROM k),
s1 AS (SELECT *, (score + CASE WHEN preferred THEN 0.05 ELSE 0 END + least(n * 0.03, 0.12)) * CASE WHEN signals_asked > 0 AND n = 0 THEN 0.82 ELSE 1 END AS s FROM m),
s2 AS (SELECT *, ((s + CASE WHEN track = preference THEN 0.18 ELSE 0 END) * CASE WHEN preference <> 'neutral' AND track <> 'unknown' AND track <> preference THEN 0.68 ELSE 1 END + least(mine * 0.04, 0.12)) * CASE WHEN other > 0 THEN 0.9 ELSE 1 END + CASE WHEN preference = 'neutral' AND track <> 'unknown' THEN 0.08 ELSE 0 END AS s2 FROM s1),
r AS (SELECT query_id, id, track, preference, round(greatest(0, least(1, s2)), 6)::DOUBLE AS score FROM s2), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM r),
w AS (SELECT *, count(*) FILTER (track = 'a') OVER q AS all_a, count(*) FILTER (track = 'b') OVER q AS all_b, count(*) FILTER (track = 'a' AND place <= 6) OVER q AS n_a, count(*) FILTER (track = 'b' AND place <= 6) OVER q AS n_b,
  coalesce(sum(score) FILTER (track = 'a' AND place <= 6) OVER q, 0) AS s_a, coalesce(sum(score) FILTER (track = 'b' AND place <= 6) OVER q, 0) AS s_b FROM o WINDOW q AS (PARTITION BY query_id)),
x AS (SELECT *, CASE WHEN preference = 'a' THEN CASE WHEN all_a >= 3 THEN 'a' END WHEN preference = 'b' THEN CASE WHEN all_b >= 3 THEN 'b' END WHEN n_b >= 3 AND n_b >= n_a + 2 AND s_b >= round(s_a * 1.35, 9) THEN 'b' WHEN n_a >= 3 AND n_a >= n_b + 2 AND s_a >= round(s_b * 1.35, 9) THEN 'a' END AS kept FROM w)
""" + _top("SELECT query_id, id, score FROM x WHERE kept IS NULL OR track = kept OR track = 'unknown'", 20))  # fmt: skip
def fus_14_track_evidence(spark, sf_dir):
    """Cases by what they share with the question and by track, which terms in both texts tell; hits of the other track go where one clearly leads."""
    rows = question_pairs(spark, sf_dir)
    lexicon = spark.createDataFrame([(t, x) for t, xs in TRACKS.items() for x in xs], "track string, term string")
    counts = bo.track_counts(table(spark, sf_dir, "documents"), lexicon, ("a", "b"), "doc_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = counts.select(F.col("doc_id").alias("id"), "first", "second")
    asked = counts.select(F.col("doc_id").alias("query_id"), F.col("first").alias("q_first"), F.col("second").alias("q_second"))
    joined = rows.join(own, "id", "left").join(asked, "query_id", "left").withColumns({c: zero(c) for c in ("first", "second", "q_first", "q_second")})
    named = joined.withColumns({
        "track": bo.leaning(F.col("first"), F.col("second"), ("a", "b"), "unknown"), "preference": bo.leaning(F.col("q_first"), F.col("q_second"), ("a", "b"), "neutral", 0.6),
        "topic": F.col("preferred").cast("int"), "signal": F.col("n"),
    })
    scored = named.withColumn("score", fs.rounded(bo.folded(F.col("score"), bo.track_evidence(), bo.TRACK_RULES))).select("query_id", "id", "score", "track", "preference")
    return top_k(bo.one_track(scored).select("query_id", "id", "score"), fs.QUERY, fs.best(), 20)


@query(f"""WITH {HITS}, j AS (SELECT query_id, id, score, rank, source, substr(text, 1, 80) AS snippet FROM hits JOIN documents ON id = doc_id)
SELECT query_id, source, id, snippet, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM j) WHERE k = 1""")
def res_1_citations(spark, sf_dir):
    rows = with_text(spark, sf_dir, hits(spark, sf_dir)).select("query_id", "id", "rank", "source", F.substring("text", 1, 80).alias("snippet"))
    first = first_per_key(rows, ["query_id", "source"], [F.col("rank")])
    return ranked(first, fs.QUERY, [F.col("rank")], "place").select("query_id", "source", "id", "snippet", "place")


@query(f"""WITH {HITS}, j AS (SELECT query_id, label, id, score FROM hits JOIN embeddings ON id = vec_id WHERE score >= 0.1 AND label <> 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS k FROM j) WHERE k = 1)
SELECT query_id, label, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 6""")
def res_2_related(spark, sf_dir):
    rows = labelled(spark, sf_dir, hits(spark, sf_dir)).filter("score >= 0.1 and label <> 0").select("query_id", "label", "id", "score")
    return top_k(first_per_key(rows, ["query_id", "label"], fs.best()), fs.QUERY, fs.best(), 6)


SHOWN = f"""{HITS}, e AS (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high, count(*) OVER w AS n FROM hits WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT *, round(score * 0.72 + score * 0.18 + CASE WHEN high - low >= 0.025 THEN greatest(0, least(1, (score - low) / (high - low))) ELSE 0.5 END * 0.07 + CASE WHEN n > 1 THEN 1 - (rank - 1) / (n - 1) ELSE 1 END * 0.03, 9) AS d FROM e),
c AS (SELECT *, CASE WHEN score < 0.25 AND score < 0.4 THEN least(d, 0.54) ELSE d END AS d1 FROM s)"""


@query(f"WITH {SHOWN} SELECT query_id, id, round(greatest(0.12, least(0.94, CASE WHEN score > 0.85 AND high - low < 0.04 THEN least(d1, 0.88) ELSE d1 END)), 2)::DOUBLE AS display_score FROM c")
def res_3_display(spark, sf_dir):
    return fs.finalize_display(hits(spark, sf_dir).withColumn("raw_score", F.col("score"))).select("query_id", "id", "display_score")


@query(f"""WITH {HITS}, {OTHER}, a AS (SELECT hits.*, bool_or(label = 3) OVER (PARTITION BY query_id) AS canonical FROM hits JOIN embeddings ON id = vec_id WHERE rank <= 5)
SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM a WHERE canonical UNION ALL SELECT query_id, id, score FROM other WHERE rank <= 5) GROUP BY query_id, id""")
def res_4_fallback_list(spark, sf_dir):
    mine = labelled(spark, sf_dir, hits(spark, sf_dir).filter("rank <= 5"))
    canonical = F.max((F.col("label") == 3).cast("int")).over(Window.partitionBy("query_id")) == 1
    kept = mine.withColumn("c", canonical).filter("c").select("query_id", "id", "score")
    others = hits(spark, sf_dir, dims=32).filter("rank <= 5").select("query_id", "id", "score")
    return kept.unionByName(others).groupBy("query_id", "id").agg(F.max("score").alias("score"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '^(https?://[^/]+)', 1), ''), 'https://example.org') || '/search?q=' || lower(regexp_extract(html, '<title>([A-Za-z]+)', 1)) AS link FROM pages""")
def res_5_deep_links(spark, sf_dir):
    base = F.coalesce(F.nullif(F.regexp_extract("url", r"^(https?://[^/]+)", 1), F.lit("")), F.lit("https://example.org"))
    word = F.url_encode(F.lower(F.regexp_extract("html", "<title>([A-Za-z]+)", 1)))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(base, F.lit("/search?q="), word).alias("link"))


@query(f"""WITH {HITS}, g AS (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS top, avg((label % 2 = 0)::INT) AS precision, max((label = 3)::INT)::DOUBLE AS coverage FROM hits JOIN embeddings ON id = vec_id GROUP BY query_id),
o AS (SELECT *, round(least(1, top * 0.5 + precision * 0.3 + coverage * 0.2), 9) AS overall FROM g)
SELECT query_id, round(overall, 2) AS overall, round(precision, 2) AS precision, coverage, round(top, 2) AS top, CASE WHEN overall >= 0.72 THEN 'high' WHEN overall >= 0.45 THEN 'medium' ELSE 'low' END AS band FROM o""")
def res_6_quality(spark, sf_dir):
    rows = labelled(spark, sf_dir, hits(spark, sf_dir))
    return fs.retrieval_quality(rows, F.col("label") % 2 == 0, F.col("label") == 3)


@query(f"""WITH {HITS} SELECT query_id, id, score, rank, fallback FROM (SELECT *, bool_and(score < 0.35) OVER (PARTITION BY query_id) AS fallback FROM hits WHERE rank > 1) WHERE (score >= 0.35 OR fallback) AND rank <= 7""")
def res_7_case_filter(spark, sf_dir):
    rest = hits(spark, sf_dir).filter("rank > 1")
    empty = F.max("score").over(Window.partitionBy("query_id")) < 0.35
    return rest.withColumn("fallback", empty).filter("(score >= 0.35 or fallback) and rank <= 7")


@query(f"""WITH {HITS} SELECT query_id, string_agg('[' || rank || '] ' || source || chr(10) || substr(text, 1, 200), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM hits JOIN documents ON id = doc_id WHERE rank <= 5 GROUP BY query_id""")
def res_8_context(spark, sf_dir):
    rows = with_text(spark, sf_dir, hits(spark, sf_dir).filter("rank <= 5"))
    block = F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("source"), F.lit("\n"), F.substring("text", 1, 200))
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["b"]), "\n---\n").alias("context"))


@query(f"""WITH {HITS}, v AS (SELECT query_id, label, sum(score) AS s FROM hits JOIN embeddings ON id = vec_id WHERE rank <= 6 GROUP BY query_id, label),
t AS (SELECT query_id, max(score) AS top FROM hits GROUP BY query_id)
SELECT query_id, label, CASE WHEN top >= 0.7 THEN 'strong' WHEN top >= 0.3 THEN 'weak' ELSE 'none' END AS strength FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, label) AS k FROM v) JOIN t USING (query_id) WHERE k = 1""")
def res_10_strength_vote(spark, sf_dir):
    rows = labelled(spark, sf_dir, hits(spark, sf_dir))
    top = rows.groupBy("query_id").agg(F.max("score").alias("top"))
    votes = rows.filter("rank <= 6").groupBy("query_id", "label").agg(F.round(F.sum("score"), 6).alias("s"))
    winner = first_per_key(votes, ["query_id"], [F.desc("s"), F.col("label")])
    strength = F.when(F.col("top") >= 0.7, "strong").when(F.col("top") >= 0.3, "weak").otherwise("none")
    return winner.join(top, "query_id").select("query_id", "label", strength.alias("strength"))


#: A mean score of exactly a limit may fall to either side in floating point; six digits decide on both sides.
ANSWER_SQL = rf"""WITH {FULL_SQL}, pf AS ({FULL_HITS}), {TF_SQL}, sf AS ({TF_HITS}), {TRIGRAM_SQL}, g AS ({_top("SELECT * FROM found", 20)}),
nf AS (SELECT query_id, (SELECT count(*) FROM pf WHERE pf.query_id = b.query_id) AS np, (SELECT count(*) FROM sf WHERE sf.query_id = b.query_id) AS ns FROM (SELECT item_id AS query_id FROM benchmark) b),
f AS (SELECT pf.* FROM pf JOIN nf USING (query_id) WHERE np >= 3 OR np >= ns UNION ALL SELECT sf.* FROM sf JOIN nf USING (query_id) WHERE NOT (np >= 3 OR np >= ns)),
fu AS (SELECT query_id, id, coalesce(f.score, 0)::DOUBLE AS v, coalesce(g.score, 0)::DOUBLE AS k, round(coalesce(1 / (60 + f.rank), 0) + coalesce(1 / (60 + g.rank), 0), 9) AS r FROM f FULL JOIN g USING (query_id, id)),
m AS (SELECT query_id, round(avg(score), 6) AS mean FROM f GROUP BY query_id),
a AS (SELECT query_id, id, round(CASE WHEN mean IS NULL THEN least(greatest(k, 0.5), 1) WHEN mean < 0.2 THEN greatest(k * 1.5, v * 0.5, least(r * 15, 1)) WHEN mean < 0.5 THEN greatest(k * 1.3, v, least(r * 12, 1)) ELSE greatest(v * 1.1, k, least(r * 10, 1)) END, 9) AS score FROM fu LEFT JOIN m USING (query_id)),
gated AS ({_top("SELECT * FROM a WHERE score >= 0.03", 30)}),
j AS (SELECT gated.*, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM gated JOIN documents ON id = doc_id),
c AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, score, source, {sql_sentence("flat", 240)} AS snippet FROM c"""


@query(ANSWER_SQL)
def answer_questions(spark, sf_dir):
    """The whole path: full text (or, for few hits, term frequency) and trigram lists of each question, fused, gated, cut to one citation a source."""
    full, grams = stored(rtv_12_fallback(spark, sf_dir)), stored(rtv_5_trigram(spark, sf_dir))
    fused_lists = fs.reciprocal_rank_fusion(full, grams)
    scored = fs.adaptive_score(fused_lists, full).select("query_id", "id", "score")
    gated = fs.candidate_gate(scored)
    rows = with_text(spark, sf_dir, gated).withColumn("snippet", snippet(collapse_space(F.col("text")))).drop("text")
    cited = first_per_key(rows, ["query_id", "source"], [F.col("rank")])
    return ranked(cited, fs.QUERY, [F.col("rank")], "place").select("query_id", "id", "place", "score", "source", "snippet")

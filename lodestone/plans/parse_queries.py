"""Extraction and chunking queries.  Heading words and lexicons are parameters; the test tables have invented words, so theirs are too."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import parse as ps
from lodestone.operators import chunk as ck
from lodestone.operators import lexicon as lx
from lodestone.operators import references as rf
from lodestone.operators import sections
from lodestone.operators.references import Wording
from lodestone.operators.rows import first_per_key
from lodestone.operators.sections import Grammar
from lodestone.plans.registry import query, table
from lodestone.plans.report_queries import CHUNKS_SQL, chunks

#: Headings of the test tables: a line of one capitalised word is a chapter, a line that begins with "The" or "Le" an article.
ARTICLE, CHAPTER = r"^(The|Le|Das|El|De) ", r"^[A-Z][a-z]*\.$"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(r"""SELECT doc_id, regexp_extract(text, '([A-Z][a-z]+ License), Version ([0-9.]+[0-9])', 1) AS title,
regexp_extract(text, 'Version ([0-9.]+[0-9])', 1) AS version, array_to_string(regexp_extract_all(text, '\b([A-Z][a-z]+)\.\n', 1), ' ') AS headings FROM documents""")
def prs_3_text_fields(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", F.regexp_extract("text", r"([A-Z][a-z]+ License), Version ([0-9.]+[0-9])", 1).alias("title"),
        F.regexp_extract("text", r"Version ([0-9.]+[0-9])", 1).alias("version"),
        F.array_join(ps.all_matches(F.col("text"), r"\b([A-Z][a-z]+)\.\n"), " ").alias("headings"),
    )


CANONICAL_SQL = r"""lower(regexp_extract({0}, '^(https://[^/?]+)', 1)) || regexp_replace(regexp_replace(regexp_replace({0}, '^https://[^/?]+', ''), '\.html?$', ''), '/+$', '')"""
CLEAN_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '#.*$', ''), '(?i)[?&](utm_[a-z]+|ref|fbclid)=[^&#]*', '', 'g'), '^http:', 'https:'), '^https://(www|m)\.', 'https://')"""


@query(rf"""SELECT page_id, {CANONICAL_SQL.format("u")} AS canonical,
coalesce(nullif(regexp_extract(url, '[?&](?:id|lawId)=([0-9]+)', 1), ''), nullif(regexp_extract(url, '^[^?#]*/([0-9]+)(?:[/.?#]|$)', 1), '')) AS number
FROM (SELECT page_id, url, {CLEAN_SQL.format("url")} AS u FROM pages)""")
def prs_4_canonical_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", ps.canonical_url(F.col("url")).alias("canonical"), ps.url_id(F.col("url")).alias("number"))


@query("""SELECT DISTINCT page_id, link FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) ||
unnest(regexp_extract_all(html, '<a href="(/[^"#]*)"', 1)) AS link FROM pages)""")
def prs_5_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    # distinct within the row: no shuffle
    found = F.array_distinct(ps.all_matches(F.col("html"), r'<a href="(/[^"#]*)"'))
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    return pages.select("page_id", host.alias("host"), F.explode(found).alias("path")).select("page_id", F.concat("host", "path").alias("link"))


@query(r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4
WHEN 0 THEN 'on ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate + INTERVAL 25 YEAR, '%Y-%m-%d.')
WHEN 2 THEN 'of ' || (2000 + o_orderkey % 50) || '.' || (1 + o_orderkey % 12) || '.7' ELSE (2000 + o_orderkey % 50) || ' year ' || (1 + o_orderkey % 12) || ' month 9' END AS t FROM orders),
w AS (SELECT o_orderkey, list_filter(string_split(replace(t, '.', '-'), ' '), lambda x: regexp_matches(x, '^20[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}-?$'))[1] AS d, string_split(t, ' ') AS f FROM t)
SELECT o_orderkey, CASE WHEN f[2] = 'year' THEN f[1] || '-' || lpad(f[3], 2, '0') || '-' || lpad(f[5], 2, '0')
WHEN d IS NULL THEN '' ELSE string_split(d, '-')[1] || '-' || lpad(string_split(d, '-')[2], 2, '0') || '-' || lpad(string_split(d, '-')[3], 2, '0') END AS iso FROM w""")
def prs_6_iso_date(spark, sf_dir):
    k = F.col("o_orderkey")
    year, month = (2000 + k % 50).cast("string"), (1 + k % 12).cast("string")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd")))
        .when(k % 4 == 1, F.date_format(F.add_months("o_orderdate", 300), "yyyy-MM-dd."))
        .when(k % 4 == 2, F.concat(F.lit("of "), year, F.lit("."), month, F.lit(".7")))
        .otherwise(F.concat(year, F.lit(" year "), month, F.lit(" month 9")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", ps.iso_date(text).alias("iso"))


RULES = [("SHANTH", "criminal"), ("CIÓN", "civil"), ("HEIT", "administrative"), ("EAUX", "constitutional")]


@query(f"SELECT doc_id, CASE {' '.join(f"WHEN contains(upper(text), '{m}') THEN '{v}'" for m, v in RULES)} ELSE 'other' END AS domain FROM documents")
def prs_7_domain(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", ps.by_precedence(F.col("text"), RULES).alias("domain"))


@query(f"SELECT doc_id, kind FROM (SELECT doc_id, CASE {' '.join(f"WHEN contains(upper(substr(text, 1, 1200)), '{m}') THEN '{v}'" for m, v in RULES)} ELSE 'other' END AS kind FROM documents) WHERE kind <> 'other'")
def prs_8_type_from_header(spark, sf_dir):
    typed = _docs(spark, sf_dir).select("doc_id", ps.by_precedence(F.substring("text", 1, 1200), RULES).alias("kind"))
    return typed.filter("kind <> 'other'")


#: A document with references in it: numbers of its own id around the text.
REF_SQL = """(SELECT doc_id, 'Law ' || (1980 + doc_id % 90) || '/' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ' and article ' || (doc_id % 700) || ', '
|| (doc_id % 40) || ' article. ' || text AS t FROM documents)"""


def _referring(spark, sf_dir):
    i = F.col("doc_id")
    text = F.concat(
        F.lit("Law "), 1980 + i % 90, F.lit("/"), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit(" and article "), i % 700,
        F.lit(", "), i % 40, F.lit(" article. "), F.col("text"),
    )
    return _docs(spark, sf_dir).select("doc_id", text.alias("t"))


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '([0-9]{{4}}[/-][0-9]{{2,3}})', 1), lambda x: replace(x, '-', '/')),
lambda x: substr(x, 1, 4)::INT BETWEEN 1990 AND 2050 AND substr(x, 6, 3)::INT >= 1))), ' ') AS laws,
array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(t, '(?i)article\s+([0-9]+)', 1), regexp_extract_all(t, '(?i)([0-9]+)\.?\s+article', 1)),
lambda x: length(x) <= 3 AND TRY_CAST(x AS INT) BETWEEN 1 AND 500))), ' ') AS articles FROM {REF_SQL}""")
def prs_9_references(spark, sf_dir):
    t = F.col("t")
    return _referring(spark, sf_dir).select(
        "doc_id", F.array_join(F.array_sort(ps.law_ids(t)), " ").alias("laws"), F.array_join(F.array_sort(ps.article_numbers(t)), " ").alias("articles")
    )


#: Wording of the test texts: what a case number and a court are called, and words that matter.
CASE_WORD, COURT_WORD, MATTERS = "Case", "court", ("license", "copyright", "version", "heit", "mente", "eaux", "anstth", "tzung")
_COURTS = rf"(?i)([^,\n.!?]{{3,50}}?)\s+(?:high|district)\s+{COURT_WORD}"
#: A document that also names a case and a court.
LEGAL_SQL = f"(SELECT doc_id, 'Case No ' || (90000 + doc_id * 7 % 200000) || ', heard at Northern ' || lang || ' high court. ' || t AS t FROM (SELECT doc_id, lang FROM documents) JOIN {REF_SQL} USING (doc_id))"


@query(rf"""WITH d AS {LEGAL_SQL}, k AS (SELECT unnest([{", ".join(f"'{m}'" for m in MATTERS)}]) AS term)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '([0-9]{{4}}[/-][0-9]{{2,3}})', 1), lambda x: replace(x, '-', '/')), lambda x: substr(x, 1, 4)::INT BETWEEN 1990 AND 2050 AND substr(x, 6, 3)::INT >= 1))), '|') AS laws,
array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(t, '(?i)article\s+([0-9]+)', 1), regexp_extract_all(t, '(?i)([0-9]+)\.?\s+article', 1)), lambda x: length(x) <= 3 AND TRY_CAST(x AS INT) BETWEEN 1 AND 500))), '|') AS articles,
array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(t, '(?i){CASE_WORD}\s+No\s*([0-9]{{5,6}})', 1), lambda x: CAST(x AS INT) >= 100000))), '|') AS cases,
array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '{_COURTS}', 1), lambda x: trim(x)), lambda x: length(x) BETWEEN 4 AND 99))), '|') AS courts,
coalesce((SELECT string_agg(term, '|' ORDER BY term) FROM k WHERE contains(lower(t), term)), '') AS keywords FROM d""")
def prs_9_legal_references(spark, sf_dir):
    """Laws, articles, cases, courts and keywords of each document; keywords come from one pass with an automaton."""
    i = F.col("doc_id")
    docs = _referring(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    t = F.concat(F.lit("Case No "), 90_000 + i * 7 % 200_000, F.lit(", heard at Northern "), "lang", F.lit(" high court. "), "t")
    lexicon = spark.createDataFrame([(n, m, "part") for n, m in enumerate(MATTERS)], "entry long, term string, how string")
    found = lx.legal_references(docs.select("doc_id", t.alias("t")), lexicon, "doc_id", "t", case_word=CASE_WORD, courts=_COURTS)
    return found.select("doc_id", *(F.array_join(F.array_sort(c), "|").alias(c) for c in ("laws", "articles", "cases", "courts", "keywords")))


@query(rf"""SELECT doc_id, CASE WHEN NOT regexp_matches(n, '^[0-9]+$') OR (length(n) <= 3 AND lpad(n, 3, '0') <= '500') THEN n END AS article FROM (SELECT doc_id,
coalesce(nullif(regexp_extract(t, '(?i)article\s*([0-9]+(?:\.[0-9]+)*)', 1), ''), nullif(regexp_extract(t, '(?i)([0-9]+(?:\.[0-9]+)*)\s*article', 1), '')) AS n FROM {REF_SQL})""")
def prs_10_article_number(spark, sf_dir):
    return _referring(spark, sf_dir).select("doc_id", ps.article_number(F.col("t")).alias("article"))


@query(r"""WITH p AS (SELECT doc_id, string_split(text, 'The ') AS parts FROM documents),
e AS (SELECT doc_id, unnest(list_slice(parts, 1, len(parts) - 1)) AS part, generate_subscripts(list_slice(parts, 1, len(parts) - 1), 1) AS i FROM p),
o AS (SELECT doc_id, i, sum(length(part)) OVER w + 4 * (i - 1) AS place FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, CAST(place AS BIGINT) AS "offset" FROM (SELECT *, lag(place) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM o) WHERE before IS NULL OR place - before > 6""")
def prs_11_markers(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(ps.marker_places(F.col("text"), "The ")).alias("offset"))


@query(r"""SELECT doc_id, array_to_string(list_slice(list_distinct_ordered, 1, 4), '|') AS headings FROM (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered
FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^([A-Z][a-z]*\.)$', 1) AS l FROM documents))""")
def prs_12_section_hints(spark, sf_dir):
    headings = F.array_distinct(ps.all_matches(F.col("text"), r"(?m)^([A-Z][a-z]*\.)$"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.slice(headings, 1, 4), "|").alias("headings"))


@query(f"""WITH {CHUNKS_SQL}, r AS (SELECT DISTINCT doc_id, chunk_index, unnest(list_filter(regexp_extract_all(text, '([A-Z][a-z]+heit)', 1), lambda x: true)) AS target FROM chunks)
SELECT target, count(*) AS n FROM r GROUP BY target""")
def prs_13_reference_edges(spark, sf_dir):
    found = F.array_distinct(ps.all_matches(F.col("text"), r"([A-Z][a-z]+heit)"))
    edges = chunks(spark, sf_dir).select("doc_id", "chunk_index", F.explode(found).alias("target"))
    return edges.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 6), '|') AS parties FROM (SELECT doc_id,
list_filter(list_transform(regexp_extract_all(text, '(?:The|Le|Das) ([a-z]+ [a-z]+)', 1), lambda x: trim(x)), lambda x: length(x) BETWEEN 3 AND 179) AS l FROM documents)""")
def prs_14_parties(spark, sf_dir):
    found = F.filter(ps.all_matches(F.col("text"), r"(?:The|Le|Das) ([a-z]+ [a-z]+)"), lambda x: F.length(x).between(3, 179))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.slice(F.array_distinct(found), 1, 6), "|").alias("parties"))


STOP = ("the", "and", "les", "der", "die", "que", "los")


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(lower(text), '[a-z0-9.]{{3,}}')), '(ing|tion|heit|ment)$', '') AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS n FROM t WHERE length(term) >= 3 AND term NOT IN {STOP} GROUP BY doc_id, term)
SELECT doc_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 12""")
def prs_15_keywords(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(ps.keywords(F.col("text"), "(ing|tion|heit|ment)$", STOP)).alias("k")).select("doc_id", "k.*")


@query(f"WITH {CHUNKS_SQL} SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY chunk_index)) AS whole, count(*) AS n FROM chunks GROUP BY doc_id")
def prs_16_assembly(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    whole = chunks(spark, sf_dir).groupBy("doc_id").agg(parts.alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    return whole.select("doc_id", F.sha2(text, 256).alias("whole"), F.size("p").cast("long").alias("n"))


@query("""SELECT c_custkey, n_nationkey FROM (SELECT c_custkey, n_nationkey, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN n_name = hint THEN 0
WHEN lower(n_name) = lower(hint) THEN 1 ELSE 2 END, n_nationkey) AS k FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'NATION_' || (c_custkey % 25)
WHEN 1 THEN 'nation_' || (c_custkey % 25) ELSE 'of nation_' || (c_custkey % 25) || '!' END AS hint FROM customer)
JOIN nation ON contains(lower(hint), lower(n_name)) OR contains(lower(n_name), lower(hint))) WHERE k = 1""")
def prs_17_title_to_id(spark, sf_dir):
    k = F.col("c_custkey")
    number = (k % 25).cast("string")
    hint = F.when(k % 3 == 0, F.concat(F.lit("NATION_"), number)).when(k % 3 == 1, F.concat(F.lit("nation_"), number)).otherwise(F.concat(F.lit("of nation_"), number, F.lit("!")))
    asked = table(spark, sf_dir, "customer").select("c_custkey", hint.alias("hint"))
    # the dictionary is the fixed list of nations (25 rows at any scale)
    names = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    low_hint, low_name = F.lower("hint"), F.lower("n_name")
    met = asked.join(names, F.contains(low_hint, low_name) | F.contains(low_name, low_hint))
    kind = F.when(F.col("n_name") == F.col("hint"), 0).when(low_name == low_hint, 1).otherwise(2)
    return first_per_key(met.withColumn("kind", kind), ["c_custkey"], [F.col("kind"), F.col("n_nationkey")]).select("c_custkey", "n_nationkey")


@query(r"""SELECT conv_id, turn, CASE WHEN c = '' THEN 0.5 ELSE least(greatest(c::DOUBLE, 0), 1) END AS confidence,
array_to_string(list_slice(regexp_extract_all(t, '(?m)^- (.+)$', 1), 1, 3), '|') AS suggestions FROM (SELECT conv_id, turn, t, regexp_extract(t, '(?i)confidence:\s*([0-9]+(?:\.[0-9]+)?)\s*$', 1) AS c
FROM (SELECT conv_id, turn, '- ' || replace(text, '. ', chr(10) || '- ') || CASE WHEN turn % 4 = 1 THEN ' Confidence: ' || (conv_id % 15) / 10.0 ELSE '' END AS t FROM conversations WHERE role = 'assistant'))""")
def prs_18_reply_fields(spark, sf_dir):
    tail = F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" Confidence: "), ((F.col("conv_id") % 15) / 10.0).cast("string"))).otherwise("")
    said = F.concat(F.lit("- "), F.replace(F.col("text"), F.lit(". "), F.lit("\n- ")), tail)
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", said.alias("t"))
    lines = ps.all_matches(F.col("t"), r"(?m)^- (.+)$")
    return rows.select("conv_id", "turn", ps.confidence(F.col("t")).alias("confidence"), F.array_join(F.slice(lines, 1, 3), "|").alias("suggestions"))


def _most_sql(body):
    return f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) {body}"


@query()
def chk_1_paragraph_packing(spark, sf_dir):
    return ck.pack_paragraphs(_docs(spark, sf_dir), mark="\n")


SEGMENTS_SQL = _most_sql(f""", m AS (SELECT *, regexp_matches(trim(line), '{ARTICLE}') AS a, regexp_matches(trim(line), '{CHAPTER}') AS c FROM l),
p AS (SELECT *, sum(a::INT) OVER w AS article_index, last_value(CASE WHEN c THEN trim(line) END IGNORE NULLS) OVER w AS chapter FROM m
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT doc_id, CAST(article_index AS BIGINT) AS article_index, max(CASE WHEN a THEN chapter END) AS chapter, max(CASE WHEN a THEN trim(line) END) AS heading,
  string_agg(line, chr(10) ORDER BY pos) AS body FROM p GROUP BY doc_id, article_index),
segments AS (SELECT * REPLACE (trim(body, ' ' || chr(10)) AS body) FROM s WHERE length(trim(body)) >= CASE WHEN article_index = 0 THEN 200 ELSE 20 END)""")


@query(SEGMENTS_SQL + " SELECT * FROM segments")
def chk_2_articles(spark, sf_dir):
    return ck.segments(_docs(spark, sf_dir), ARTICLE, CHAPTER)


CLAUSE = "^([A-Z][a-z]+) [a-z]"


@query(SEGMENTS_SQL + f""", cl AS (SELECT doc_id, article_index, length(body) AS chars, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM segments),
n AS (SELECT *, nullif(regexp_extract(line, '{CLAUSE}', 1), '') AS number FROM cl),
k AS (SELECT *, count(number) OVER (PARTITION BY doc_id, article_index) >= 3 OR chars > 600 AS splits, count(number) OVER (PARTITION BY doc_id, article_index ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM n)
SELECT doc_id, article_index, CASE WHEN splits THEN c ELSE 0 END AS clause_index, max(CASE WHEN splits THEN number END) AS clause_no, string_agg(line, chr(10) ORDER BY pos) AS clause
FROM k GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY doc_id, article_index, CASE WHEN splits THEN c ELSE 0 END"))
def chk_3_clauses(spark, sf_dir):
    articles = ck.segments(_docs(spark, sf_dir), ARTICLE, CHAPTER)
    return ck.clauses(articles, ["doc_id", "article_index"], CLAUSE)


@query(_most_sql(f""", m AS (SELECT *, sum(regexp_matches(trim(line), '{CHAPTER}')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section,
max(regexp_matches(trim(line), '{ARTICLE}')::INT) OVER (PARTITION BY doc_id) AS has_article FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, string_agg(line, chr(10) ORDER BY pos) AS body FROM m WHERE has_article = 0 GROUP BY doc_id, section"""))
def chk_4_sections(spark, sf_dir):
    return ck.sections(_docs(spark, sf_dir), ARTICLE, CHAPTER)


@query()
def chk_5_sentence_packing(spark, sf_dir):
    return ck.pack_sentences(_docs(spark, sf_dir))


@query("""SELECT doc_id, CAST(s / 480 AS BIGINT) AS chunk_index, s AS char_start, trim(substr(text, s + 1, 600)) AS chunk
FROM documents, unnest(range(0, greatest(length(text) - 121, 0) + 1, 480)) AS t(s) WHERE trim(substr(text, s + 1, 600)) <> ''""")
def chk_6_windows(spark, sf_dir):
    return ck.windows(_docs(spark, sf_dir).select("doc_id", "text"))


@query()
def chk_7_merge_small(spark, sf_dir):
    lines = ck.lines(_docs(spark, sf_dir), "doc_id", "text")
    return ck.merge_small(lines, ["doc_id"], "pos", "line")


@query(_most_sql(r""", k AS (SELECT doc_id, pos, sha256(doc_id || ':' || substr(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), 1, 200)) AS key FROM l)
SELECT doc_id, min(pos) AS pos, key FROM k GROUP BY doc_id, key"""))
def chk_8_piece_dedup(spark, sf_dir):
    lines = ck.lines(_docs(spark, sf_dir), "doc_id", "text")
    keyed = lines.select("doc_id", "pos", ck.piece_key(F.col("line"), F.col("doc_id")).alias("key"))
    return keyed.groupBy("doc_id", "key").agg(F.min("pos").alias("pos"))


@query(SEGMENTS_SQL + r""", h AS (SELECT *, concat_ws(chr(10), 'Chapter: ' || substr(trim(regexp_replace(chapter, '\s+', ' ', 'g')), 1, 180), 'Article: ' || substr(trim(regexp_replace(heading, '\s+', ' ', 'g')), 1, 180)) AS head FROM segments)
SELECT h.doc_id, article_index, CASE WHEN head = '' THEN trim(body) ELSE head || chr(10) || chr(10) || trim(body) END AS chunk, strpos(text, substr(body, 1, 120)) AS found FROM h JOIN documents USING (doc_id)""")
def chk_9_context(spark, sf_dir):
    articles = ck.segments(_docs(spark, sf_dir), ARTICLE, CHAPTER)
    chunk = ck.contextual(F.col("body"), chapter=F.col("chapter"), article=F.col("heading"))
    return articles.join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id").select(
        "doc_id", "article_index", chunk.alias("chunk"), F.expr("locate(substring(body, 1, 120), text)").alias("found")
    )


@query(SEGMENTS_SQL + " SELECT doc_id, count(*) AS chunks, sum(length(body)) AS chars, round(avg(length(body)), 2) AS mean_chars, count(DISTINCT sha256(body)) AS distinct_chunks FROM segments GROUP BY doc_id".replace("sum(length(body))", "CAST(sum(length(body)) AS BIGINT)"))
def chk_10_statistics(spark, sf_dir):
    n = F.length("body")
    return ck.segments(_docs(spark, sf_dir), ARTICLE, CHAPTER).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(n).alias("chars"), F.round(F.avg(n), 2).alias("mean_chars"),
        F.count_distinct(F.sha2("body", 256)).alias("distinct_chunks"),
    )


#: Statutes made of the documents: of every nine lines the first is a chapter's heading, the second an article's, four are clauses, two are labelled, the last goes on.
STATUTE = Grammar(article=r"^([0-9]+) article\.\s*(.*)$", chapter=r"^CHAPTER [0-9]+\.", reference=r"(?i)\bversion\s+[0-9]+(?:\.[0-9]+)*", amendment=r"(?i)license", suffix=r"(?:ing|ed)$", stop=("the", "and"))
STATUTE_SQL = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
s AS (SELECT doc_id, i, i // 9 + 1 AS k, i % 9 AS m, CASE i % 9 WHEN 0 THEN 'CHAPTER ' || (i // 9 + 1) || '. ' WHEN 1 THEN (i // 9 + 1) || ' article. ' WHEN 6 THEN 'a) ' WHEN 7 THEN 'b) ' WHEN 8 THEN '- see article ' || (i // 9) || ' and ' || (i // 9 + 1) || '.2, this article, Law 2001/' || (10 + i // 9 % 90) || ' article 3 and 4.1; this law, article 2. ' ELSE (i // 9 + 1) || '.' || (i % 9 - 1) || ' ' END || line AS line FROM l),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(length(line) + 1) OVER (PARTITION BY doc_id) - 1 AS size,
  CASE m WHEN 0 THEN 'chapter' WHEN 1 THEN 'article' WHEN 6 THEN 'subclause' WHEN 7 THEN 'subclause' WHEN 8 THEN NULL ELSE 'clause' END AS kind FROM s),
n AS (SELECT *, row_number() OVER w - 1 AS node, CASE kind WHEN 'article' THEN CAST(k AS VARCHAR) WHEN 'clause' THEN k || '.' || (m - 1) WHEN 'subclause' THEN k || '.4.' || CASE m WHEN 6 THEN 'a' ELSE 'b' END ELSE '' END AS no,
  coalesce(CASE kind WHEN 'chapter' THEN start + length(line) WHEN 'article' THEN min(CASE WHEN kind = 'article' THEN start END) OVER after - 1 WHEN 'clause' THEN min(CASE WHEN kind IN ('article', 'clause') THEN start END) OVER after - 1
    ELSE min(CASE WHEN kind IN ('article', 'clause', 'subclause') THEN start END) OVER after - 1 END, size) AS stop
  FROM o WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i), after AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
tree AS (SELECT doc_id, CAST(node AS INT) AS node, CAST(CASE kind WHEN 'clause' THEN last_value(CASE WHEN kind = 'article' THEN node END IGNORE NULLS) OVER u WHEN 'subclause' THEN last_value(CASE WHEN kind = 'clause' THEN node END IGNORE NULLS) OVER u ELSE -1 END AS INT) AS parent,
  kind, no, CAST(i AS INT) AS first_line, CAST(start AS INT) AS char_start, CAST(stop AS INT) AS char_end FROM n WINDOW u AS (PARTITION BY doc_id ORDER BY i))"""


def statutes(spark, sf_dir):
    def marked(line, i):
        k, m = F.floor(i / 9) + 1, i % 9
        mark = F.when(m == 0, F.concat(F.lit("CHAPTER "), k, F.lit(". "))).when(m == 1, F.concat(k, F.lit(" article. "))).when(m == 6, "a) ").when(m == 7, "b) ").when(m == 8, F.concat(F.lit("- see article "), k - 1, F.lit(" and "), k, F.lit(".2, this article, Law 2001/"), 10 + (k - 1) % 90, F.lit(" article 3 and 4.1; this law, article 2. ")))
        return F.concat(mark.otherwise(F.concat(k, F.lit("."), m - 1, F.lit(" "))), line)

    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), marked), "\n").alias("text"), F.concat(F.lit("Act of "), "source").alias("title"))


@query(f"WITH {STATUTE_SQL} SELECT * FROM tree")
def chk_3_section_tree(spark, sf_dir):
    """Chapters, articles, clauses and labelled parts of each statute, with what they stand in and where."""
    return sections.tree_table(statutes(spark, sf_dir), STATUTE).drop("path", "chapter")


@query(f"""WITH {STATUTE_SQL}, whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM s GROUP BY doc_id)
SELECT doc_id, no, sha256(substr(text, char_start + 1, char_end - char_start)) AS own FROM tree JOIN whole USING (doc_id) WHERE kind IN ('clause', 'subclause')""")
def prs_12_subsections(spark, sf_dir):
    """The numbered parts of each statute with their texts."""
    parts = F.filter(F.col("nodes"), lambda n: n["kind"].isin("clause", "subclause"))
    docs = statutes(spark, sf_dir)
    nodes = sections.tree_table(docs, STATUTE).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "no", "char_start", "char_end")).alias("nodes"))
    cut = docs.join(nodes, "doc_id").select("doc_id", "text", F.explode(parts).alias("n"))
    return cut.select("doc_id", "n.no", F.sha2(F.substring("text", F.col("n.char_start") + 1, F.col("n.char_end") - F.col("n.char_start")), 256).alias("own"))


@query()
def chk_10_chunk_rows(spark, sf_dir):
    """Statutes end to end: a row for each chunk with its place in the tree and the text, what it refers to, its words, hash and id."""
    return sections.chunk_rows(statutes(spark, sf_dir), STATUTE, law="title")


@query(f"""WITH {STATUTE_SQL}, whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM s GROUP BY doc_id),
t AS (SELECT tree.*, substr(text, char_start + 1, char_end - char_start) AS own, sum((kind = 'article')::INT) OVER (PARTITION BY doc_id ORDER BY node) AS g FROM tree JOIN whole USING (doc_id))
SELECT doc_id, max(no) FILTER (kind = 'article') AS article_no, sha256(max(own) FILTER (kind = 'article')) AS body, coalesce(string_agg(no || ' ' || sha256(own), '|' ORDER BY node) FILTER (kind IN ('clause', 'subclause')), '') AS parts
FROM t WHERE g > 0 AND kind <> 'chapter' GROUP BY doc_id, g""")
def prs_16_articles(spark, sf_dir):
    """Each article of each statute whole, with its numbered parts."""
    rows = sections.article_rows(statutes(spark, sf_dir), STATUTE)
    parts = F.zip_with("numbers", "texts", lambda n, t: F.concat(n, F.lit(" "), F.sha2(t, 256)))
    return rows.select("doc_id", "article_no", F.sha2("body", 256).alias("body"), F.array_join(parts, "|").alias("parts"))


_MENTION_SQL = Wording.mention


@query(rf"""WITH {STATUTE_SQL}, whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM s GROUP BY doc_id),
a AS (SELECT tree.doc_id, node, '2001/' || (10 + doc_id % 90) AS law, no AS article, regexp_extract_all(substr(text, char_start + 1, char_end - char_start), '{_MENTION_SQL}', 0) AS l FROM tree JOIN whole USING (doc_id) WHERE kind = 'article'),
m AS (SELECT doc_id, node, law, article, unnest(l) AS said, generate_subscripts(l, 1) AS i FROM a),
k AS (SELECT *, lower(said) LIKE 'law%' AS names, lower(said) LIKE 'this%' AS own, regexp_extract(said, '([0-9]+(?:\.[0-9]+)*)$', 1) AS number FROM m),
f AS (SELECT *, coalesce(last_value(CASE WHEN names THEN regexp_extract(said, '([0-9]{{4}}/[0-9]{{2,3}})', 1) WHEN own THEN law END IGNORE NULLS) OVER (PARTITION BY doc_id, node ORDER BY i), law) AS now FROM k),
e AS (SELECT doc_id, node, law, article, i, CASE WHEN own THEN law ELSE now END AS to_law, CASE WHEN own THEN article ELSE split_part(number, '.', 1) END AS to_article, CASE WHEN NOT own AND contains(number, '.') THEN number ELSE '' END AS to_clause FROM f WHERE NOT names AND lower(said) <> 'this law'),
u AS (SELECT doc_id, node, law, article, to_law, to_article, to_clause, min(i) AS i FROM e GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, node ORDER BY i) AS place FROM u)
SELECT DISTINCT law, article, to_law, to_article, to_clause, (to_law, to_article) IN (SELECT (law, article) FROM a) AS resolved FROM c WHERE place <= 12 AND (law <> to_law OR article <> to_article)""")
def prs_13_resolved_edges(spark, sf_dir):
    """References between the articles of all statutes; several documents are versions of one law."""
    rows = sections.article_rows(statutes(spark, sf_dir), STATUTE)
    law = F.concat(F.lit("2001/"), 10 + F.col("doc_id") % 90)
    return rf.edges(rows.select(law.alias("law"), F.col("article_no").alias("article"), "body"), "body")

"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.plans.registry import query, table

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINES = r"""array_to_string(list_transform(string_split({}, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), chr(10))"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    rf"""
WITH a AS (SELECT doc_id, regexp_replace(replace(nfc_normalize(text), chr(160), ' '), '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{feff}}]', '', 'g') AS t FROM documents),
b AS (SELECT doc_id, {TRIM.format("regexp_replace(" + LINES.format("replace(t, chr(13) || chr(10), chr(10))") + r", '\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM a),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\x{{ab}}\x{{bb}}\x{{201c}}\x{{201d}}]', '"', 'g'), '[\x{{2018}}\x{{2019}}]', '''', 'g') AS t FROM b)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s*\.\s*', '. ', 'g'), '\s*:\s*', ': ', 'g'),
  '[ \t]{{2,}}', ' ', 'g'), '\n\s+\n', chr(10) || chr(10), 'g') AS normalized FROM c
"""
)
def txt_1_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))


@query(
    r"""
SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed,
  CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 197) || '...' END AS cut FROM documents
"""
)
def txt_2_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.collapse_space(F.col("text")).alias("collapsed"), tx.truncate_text(F.col("text")).alias("cut"))


STRIP_SQL = "html"
for _block in ("script", "style", "form", "nav", "header", "footer"):
    STRIP_SQL = rf"regexp_replace({STRIP_SQL}, '(?is)<{_block}[^>]*>.*?</{_block}>', ' ', 'g')"
STRIP_SQL = rf"regexp_replace(regexp_replace({STRIP_SQL}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', '', 'g')"


@query(
    f"""
SELECT page_id, stripped, length(html) AS html_chars, length(stripped) AS text_chars, len(string_split(stripped, chr(10))) AS n_lines
FROM (SELECT page_id, html, {STRIP_SQL} AS stripped FROM pages)
"""
)
def txt_3_strip_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("stripped", tx.strip_html(F.col("html")))
    return pages.select(
        "page_id", "stripped", F.length("html").alias("html_chars"), F.length("stripped").alias("text_chars"),
        F.size(F.split("stripped", "\n", -1)).alias("n_lines"),
    )


def sql_chain(column, patterns):
    for pattern, to in patterns:
        column = f"regexp_replace({column}, '{pattern}', '{to}', 'g')"
    return column


_BOILER = [(p, "") for p in tx.BOILERPLATE]


@query(f"SELECT doc_id, {sql_chain('text', _BOILER)} AS cleaned FROM documents")
def txt_5_boilerplate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.remove_patterns(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, masked, masked <> text AS changed FROM (SELECT doc_id, text, {sql_chain('text', tx.MASKS)} AS masked FROM documents)")
def txt_6_mask(spark, sf_dir):
    masked = _docs(spark, sf_dir).withColumn("masked", tx.mask(F.col("text")))
    return masked.select("doc_id", "masked", (F.col("masked") != F.col("text")).alias("changed"))


def _sql_any(column, patterns):
    return " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns)


@query(
    f"""
SELECT 'document' AS kind, doc_id AS id, 0 AS turn, {_sql_any("text", tx.RISKS)} AS risky FROM documents
UNION ALL SELECT 'turn', conv_id, turn, {_sql_any("text", tx.RISKS)} FROM conversations
"""
)
def txt_7_personal_data(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    return docs.unionByName(turns).select("kind", "id", "turn", tx.has_personal_data(F.col("text")).alias("risky"))


def sql_sentence(column, most):
    sentence = rf"regexp_extract(substr({column}, 1, {most}), '(?s)^(.*[.!?\n\x{{3002}}])', 1)"
    words = f"regexp_extract(substr({column}, 1, {most}), '(?s)^(.*) ', 1)"
    cut = f"CASE WHEN length({sentence}) - 1 > {most * 0.5} THEN {sentence} WHEN length({words}) > {most * 0.4} THEN {words} ELSE substr({column}, 1, {most}) END"
    return f"CASE WHEN length({column}) <= {most} THEN {column} ELSE {TRIM.format(cut)} END"


@query(f"SELECT doc_id, {sql_sentence('text', 500)} AS cut, {sql_sentence('text', 240)} AS snippet FROM documents")
def txt_8_truncate_sentence(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.truncate_at_sentence(F.col("text"), 500).alias("cut"), tx.snippet(F.col("text")).alias("snippet"))


@query(
    rf"""
WITH a AS (SELECT doc_id, {sql_chain("text", _BOILER)} AS t FROM documents),
b AS (SELECT doc_id, trim(regexp_replace({sql_chain("t", tx.MASKS)}, '\s+', ' ', 'g')) AS t FROM a)
SELECT doc_id, {sql_sentence("t", 600)} AS clean FROM b
"""
)
def txt_9_sanitize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.sanitize(F.col("text"), 600).alias("clean"))


@query(f"SELECT conv_id, turn, {_sql_any('text', tx.INJECTIONS)} AS injection FROM conversations")
def txt_10_injection(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.has_injection(F.col("text")).alias("injection"))


@query(
    rf"""
SELECT doc_id, array_to_string(list_filter(list_transform(
  list_filter(string_split(text, chr(10)), lambda l: NOT ({_sql_any("l", tx.NOISE_LINES)})),
  lambda l: trim(regexp_replace({sql_chain("l", [(p, "") for p in tx.NOISE_INLINE])}, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS clean
FROM documents
"""
)
def txt_11_noise(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.strip_noise(F.col("text")).alias("clean"))


@query(
    r"""
SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[àâçèéêëîïôùû]')) AS accented,
  count(*) FILTER (regexp_matches(text, '[äöüß]')) AS umlauts,
  count(*) FILTER (regexp_matches(text, '[\x{c3}\x{c2}\x{d0}\x{d1}][\x{80}-\x{bf}]')) AS mojibake
FROM documents GROUP BY lang
"""
)
def txt_12_scripts(spark, sf_dir):
    text = F.col("text")
    return _docs(spark, sf_dir).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(tx.has_letters_of(text, "àâçèéêëîïôùû")).alias("accented"),
        F.count_if(tx.has_letters_of(text, "äöüß")).alias("umlauts"),
        F.count_if(tx.has_mojibake(text)).alias("mojibake"),
    )


@query(
    r"""
SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS by_chars, len(regexp_extract_all(text, '\S+')) AS by_words,
  greatest(1, len(regexp_extract_all(text, '\S+'))) AS at_least_one FROM documents
"""
)
def txt_13_token_estimates(spark, sf_dir):
    text = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", tx.tokens_by_chars(text).alias("by_chars"), tx.tokens_by_words(text).alias("by_words"),
        F.greatest(F.lit(1).cast("long"), tx.tokens_by_words(text)).alias("at_least_one"),
    )


@query(
    """
SELECT doc_id, h AS sha256, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-'
  || substr('89ab', CAST(('0x' || substr(h, 17, 1))::INT & 3 AS INT) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
FROM (SELECT doc_id, sha256(text) AS h FROM documents)
"""
)
def txt_14_hashes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha256"), tx.stable_uuid(F.col("text")).alias("uuid"))

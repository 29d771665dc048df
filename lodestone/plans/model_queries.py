"""Queries with an opaque step (element tree, model, index) and the streaming ingest; SQL only where it can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import models
from lodestone.operators.chunk import windows
from lodestone.plans.registry import query, scratch, table
from lodestone.plans.search_queries import HITS, _vectors, hits, with_text
from lodestone.plans.text_queries import sql_chain
from lodestone.sources import html
from lodestone.streaming import ingest


@query()
def txt_4_clean_html(spark, sf_dir):
    return html.clean_html(table(spark, sf_dir, "pages"))


@query()
def prs_1_page_documents(spark, sf_dir):
    return html.documents_of(table(spark, sf_dir, "pages")).select("page_id", "title", "n_lines", "n_headings", "text")


@query()
def prs_2_page_summaries(spark, sf_dir):
    return html.documents_of(table(spark, sf_dir, "pages"), 1).select("page_id", "n_lines", "summary", F.map_keys("fields").alias("field_names"))


@query()
def ing_6_embed(spark, sf_dir):
    return models.embed(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def rtv_2_index_top_k(spark, sf_dir):
    items = _vectors(spark, sf_dir)
    return models.indexed_top_k(items.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), items, 10)


_SPLIT_SQL = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> ''))"


@query(f"""WITH {HITS}, w AS (SELECT doc_id, {_SPLIT_SQL.format("text")} AS ws FROM documents),
j AS (SELECT h.query_id, h.id, h.rank, h.score, len(list_intersect(q.ws, d.ws)) / greatest(len(q.ws), 1) AS model FROM hits h JOIN w d ON h.id = d.doc_id JOIN w q ON h.query_id = q.doc_id),
s AS (SELECT query_id, id, CASE WHEN rank <= 10 THEN round(0.6 * score + 0.4 * model, 6) ELSE score END AS score FROM j)
SELECT query_id, id, score, false AS model_failed, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s""")
def fus_6_cross_encoder(spark, sf_dir):
    """Documents that ask are whole texts; the model shares their words with each hit's."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    rows = with_text(spark, sf_dir, hits(spark, sf_dir)).join(asked, "query_id")
    return models.cross_encoder_blend(rows, "question", "text", models.word_overlap)


@query("SELECT page_id, lang, length(html) AS chars FROM (SELECT page_id, html, regexp_extract(url, '/(en|de|fr|es)/', 1) AS lang FROM pages)")
def src_6_stage_snapshots(spark, sf_dir):
    path = scratch(spark)
    lang = F.regexp_extract("url", "/(en|de|fr|es)/", 1)
    rows = table(spark, sf_dir, "pages").select("page_id", "html", lang.alias("lang"))
    for part in (0, 1):
        rows.filter(F.col("page_id") % 2 == part).write.mode("append").partitionBy("lang").json(path)
    read = spark.read.schema("page_id long, html string, lang string").json(path)
    named = F.coalesce(F.nullif(F.col("lang"), F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit(""))
    return read.select("page_id", named.alias("lang"), F.length("html").alias("chars"))


_CLEAN_SQL = rf"trim(regexp_replace({sql_chain(sql_chain('text', [(p, '') for p in tx.BOILERPLATE]), tx.MASKS)}, '\s+', ' ', 'g'))"
INGEST_SQL = rf"""WITH c AS (SELECT sha256(text) AS content_hash, any_value({_CLEAN_SQL}) AS t FROM documents WHERE length(text) >= {ingest.LEAST} GROUP BY sha256(text))
SELECT content_hash, chunk_index, chunk FROM (SELECT content_hash, CAST(s / 480 AS INT) AS chunk_index, trim(substr(t, CAST(s AS BIGINT) + 1, 600)) AS chunk FROM c, unnest(range(0, greatest(length(t) - 121, 0) + 1, 480)) AS x(s)) WHERE chunk <> ''"""


def _ingested(spark, sf_dir):
    """Documents land in files, two of which make a batch of the stream.

    Those that have a label come as a draft first and in their last form
    later, together with texts that are known already; the second run goes on
    where the first one ended.
    """
    target = scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drafted = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("drafted", F.lit(True)), "doc_id", "left")
    draft = F.when(F.col("drafted"), F.concat(F.lit("Draft. "), "text")).otherwise(F.col("text"))
    for wave, rows in ((1, drafted.select("doc_id", draft.alias("text"))), (2, drafted.filter("drafted or length(text) > 3000").select("doc_id", "text"))):
        rows.repartition(3, "doc_id").write.mode("append").parquet(f"{target}/landing")
        ingest.ingest(spark, f"{target}/landing", docs.schema, target, f"{target}/checkpoint", files_per_batch=2 if wave == 1 else None)
    return target


@query(INGEST_SQL)
def ing_11_stream(spark, sf_dir):
    return ingest.chunk_table(spark, _ingested(spark, sf_dir)).select("content_hash", "chunk_index", "chunk")


@query(f"SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE length(text) >= {ingest.LEAST}")
def ing_11_versions(spark, sf_dir):
    """The latest version of each document after both runs."""
    return ingest.documents(spark, _ingested(spark, sf_dir)).select("doc_id", "content_hash")


@query(f"""WITH d AS (SELECT doc_id, text, doc_id IN (SELECT doc_id FROM labels) AS drafted FROM documents),
v AS (SELECT doc_id, CASE WHEN drafted THEN 'Draft. ' || text ELSE text END AS text FROM d UNION ALL SELECT doc_id, text FROM d WHERE drafted OR length(text) > 3000),
f AS (SELECT doc_id, CASE WHEN length(text) < {ingest.LEAST} THEN 'parse-validate' WHEN {_CLEAN_SQL} = '' THEN 'chunk' END AS stage, length(text) AS n FROM v)
SELECT doc_id, stage, CASE stage WHEN 'chunk' THEN 'Chunking produced zero chunks' ELSE 'Parsed text too short (' || n || ' < {ingest.LEAST})' END AS reason, count(*) AS attempts FROM f WHERE stage IS NOT NULL GROUP BY ALL""")
def ing_11_dead_letters(spark, sf_dir):
    return ingest.dead_letters(spark, _ingested(spark, sf_dir)).drop("arrived")


@query(INGEST_SQL)
def ing_11_batch(spark, sf_dir):
    """The batch form of the same ingest; the stream must give equal rows."""
    return windows(ingest.clean_batch(table(spark, sf_dir, "documents"))).select("content_hash", "chunk_index", "chunk")

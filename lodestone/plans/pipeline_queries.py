"""Sources and sinks, ingestion accounting, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import quality
from lodestone.operators.evaluate import answer_quality, citation_accuracy, faithfulness, latency_summary, regression_gate, run_summary
from lodestone.operators.ingest import failing_stage, fail_fast, page_fault, pending, prepare_for_model, resized
from lodestone.operators.rows import replace_children, top_k, upsert
from lodestone.operators.store import Store, cascade, upsert_documents
from lodestone.plans.registry import query, scratch, table
from lodestone.plans.report_queries import CHUNKS_SQL, chunks
from lodestone.plans.search_queries import HITS, OTHER, hits, labelled
from lodestone.plans.text_queries import STRIP_SQL
from lodestone.sources.jsonl import validated
from lodestone.sources.pages import page_files


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")




@query("""SELECT doc_id, kind, CASE WHEN kind = 'broken' THEN 'bad_json' WHEN kind = 'partial' THEN 'missing_source' WHEN trim(text) = '' THEN 'missing_text' END AS error,
CASE WHEN kind = 'whole' AND trim(text) <> '' THEN length(text) END AS chars FROM documents, (VALUES ('whole'), ('broken'), ('partial')) AS k(kind)""")
def src_1_jsonl(spark, sf_dir):
    """The lines of a file: every document whole, and beside it a broken, a partial and a blank line."""
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "lang", "source", "text"))
    part = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "lang"))
    written = {"whole": whole, "broken": F.substring(whole, 1, 9), "partial": part, "blank": F.lit(" ")}
    lines = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), line.alias("value")) for kind, line in written.items())))
    rows = validated(_docs(spark, sf_dir).select("doc_id", lines.alias("l")).select("doc_id", "l.*"), "value", ["id", "lang", "source", "text"])
    return rows.select("doc_id", "kind", "error", F.when(F.col("error").isNull(), F.length("record.text")).alias("chars"))


@query(r"""SELECT external_id, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars, min(length(html)) AS shortest FROM (SELECT html, 'p' || (page_id % 997) AS external_id FROM pages) WHERE length(html) >= 800 GROUP BY external_id""")
def src_2_pages(spark, sf_dir):
    """Pages land as files in folders, and are read back as a directory of files; the id is in the file's path."""
    path = scratch(spark)
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id") % 997).alias("external_id"), F.to_json(F.struct("html")).alias("value"))
    pages.repartition("external_id").write.partitionBy("external_id").text(path)
    read = page_files(spark, path, r"external_id=([^/]+)/", whole=False).withColumn("html", F.from_json("value", "html string")["html"])
    return read.filter(F.length("html") >= 800).groupBy("external_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).alias("chars"), F.min(F.length("html")).alias("shortest"))


@query("""SELECT trim(url) AS url FROM pages WHERE trim(url) <> '' UNION SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) || unnest(regexp_extract_all(html, '<a href="(/[^"#]*)"', 1)) FROM pages""")
def src_3_seed_merge(spark, sf_dir):
    """The pages' own addresses and all addresses they link to, each once."""
    pages = table(spark, sf_dir, "pages")
    own = pages.select(F.trim("url").alias("url")).filter("url <> ''")
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    linked = pages.select(host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"#]*)"'), F.lit(1))).alias("path"))
    return own.union(linked.select(F.concat("host", "path"))).distinct()


@query(rf"""WITH {CHUNKS_SQL} SELECT c.doc_id, chunk_index, lang, substr(c.text, 1, 200) AS snippet,
array_to_string(list_slice(regexp_extract_all(c.text, '[a-zA-Z]{{4,}}', 0), 1, 10), ' ') AS keywords FROM chunks c JOIN documents d ON c.doc_id = d.doc_id""")
def src_4_chunk_export(spark, sf_dir):
    pieces = chunks(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    keywords = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[a-zA-Z]{4,}"), F.lit(0)), 1, 10), " ")
    return pieces.select("doc_id", "chunk_index", "lang", F.substring("text", 1, 200).alias("snippet"), keywords.alias("keywords"))


@query(f"""WITH {CHUNKS_SQL} SELECT form, d.doc_id, d.source, substr(d.text, 1, 40) AS title, n AS chunks
FROM (SELECT d.doc_id, d.source, d.text, count(c.doc_id) AS n FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id, d.source, d.text) d, (VALUES ('csv'), ('json')) AS f(form)""")
def src_5_document_export(spark, sf_dir):
    """Documents with their chunk counts, written as CSV and as JSON, newest (largest id) first, and read back."""
    counts = chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    docs = _docs(spark, sf_dir).select("doc_id", "source", F.substring("text", 1, 40).alias("title"))
    rows = docs.join(counts, "doc_id", "left").select("doc_id", "source", "title", F.coalesce("n", F.lit(0)).alias("chunks"))
    path, schema = scratch(spark), "doc_id long, source string, title string, chunks long"
    csv = {"header": True, "multiLine": True, "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ordered = rows.orderBy(F.desc("doc_id"))
    ordered.write.options(**csv).csv(f"{path}/csv")
    ordered.write.json(f"{path}/json")
    read = spark.read.schema(schema).options(**csv).csv(f"{path}/csv").withColumn("form", F.lit("csv")).unionByName(spark.read.schema(schema).json(f"{path}/json").withColumn("form", F.lit("json")))
    return read.select("form", "doc_id", "source", "title", "chunks")


@query(f"""WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, CASE WHEN doc_id % 9 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS hash FROM chunks
WHERE doc_id % 9 <> 0 OR chunk_index < 2""")
def src_7_replace_children(spark, sf_dir):
    old = chunks(spark, sf_dir).select("doc_id", "chunk_index", F.sha2("text", 256).alias("hash"))
    changed = _docs(spark, sf_dir).filter("doc_id % 9 = 0").select("doc_id")
    new = chunks(spark, sf_dir).filter("doc_id % 9 = 0 and chunk_index < 2")
    return replace_children(old, changed, new.select("doc_id", "chunk_index", F.sha2(F.concat("text", F.lit("!")), 256).alias("hash")), "doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'moved' ELSE source END AS source, CASE WHEN doc_id % 10 = 3 THEN 'new' ELSE 'kept' END AS state FROM documents""")
def src_8_upsert(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "source")
    base = docs.filter("doc_id % 10 <> 3").withColumn("state", F.lit("kept"))
    delta = docs.filter("doc_id % 10 = 3 or doc_id % 4 = 0").select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, "moved").otherwise(F.col("source")).alias("source"), F.lit("new").alias("state")
    )
    return upsert(base, delta, ["doc_id"], keep=["state"])


#: A store of documents from before: those with a good label are missing, English ones have ids of an older kind; then all labelled ones are delivered with a new text.
STORE_SQL = f"""{CHUNKS_SQL}, l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT source, CAST(doc_id AS VARCHAR) AS source_id, d.doc_id, lang, text, l.doc_id IS NOT NULL AS delivered, coalesce(quality, 0) <> 1 AS known, sha256(source || chr(31) || d.doc_id) AS h FROM documents d LEFT JOIN l USING (doc_id)),
s AS (SELECT *, CASE WHEN known AND lang = 'en' THEN 'old-' || source_id ELSE substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(h, 17, 1) AS INT) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) END AS id FROM d)"""


def _stored_documents(spark, sf_dir):
    """``documents, chunks``: the store after the delivery."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("delivered", F.lit(True))
    docs = _docs(spark, sf_dir).join(labels, "doc_id", "left").withColumns({"source_id": F.col("doc_id").cast("string"), "known": F.coalesce(F.col("quality"), F.lit(0)) != 1})
    keys, path = ["source", "source_id"], scratch(spark)
    documents = Store(spark, f"{path}/documents", "source string, source_id string, id string, chars long", keys)
    pieces = Store(spark, f"{path}/chunks", "source string, source_id string, chunk_index long, hash string", keys)
    cut = chunks(spark, sf_dir).select("doc_id", "chunk_index", F.sha2("text", 256).alias("hash")).join(docs.select("doc_id", *keys, "known", "delivered"), "doc_id")
    old_id = F.when(F.col("lang") == "en", F.concat(F.lit("old-"), "source_id")).otherwise(tx.stable_uuid(F.concat_ws("\x1f", *keys)))
    documents.create(docs.filter("known").select(*keys, old_id.alias("id"), F.length("text").cast("long").alias("chars")))
    pieces.create(cut.filter("known").select(*keys, "chunk_index", "hash"))
    delta = docs.filter("delivered").select(*keys, (F.length("text") + 9).cast("long").alias("chars"))
    upsert_documents(documents, pieces, delta, cut.filter("delivered and chunk_index < 3").select(*keys, "chunk_index", F.concat(F.lit("new "), "hash").alias("hash")))
    return documents, pieces


@query(f"""WITH {STORE_SQL} SELECT id, source_id, chunk_index, CASE WHEN delivered THEN 'new ' || sha256(c.text) ELSE sha256(c.text) END AS hash FROM s JOIN chunks c USING (doc_id) WHERE (known OR delivered) AND (NOT delivered OR chunk_index < 3)""")
def src_7_upsert_documents(spark, sf_dir):
    """Documents keep their stored ids and all chunks of those delivered are replaced; partitions that nothing touches are not rewritten."""
    documents, pieces = _stored_documents(spark, sf_dir)
    return pieces.read().join(documents.read().select("source", "source_id", "id"), ["source", "source_id"]).select("id", "source_id", "chunk_index", "hash")


@query(f"WITH {STORE_SQL} SELECT id, source, source_id, CAST(length(text) + CASE WHEN delivered THEN 9 ELSE 0 END AS BIGINT) AS chars FROM s WHERE known OR delivered")
def src_8_key_upsert(spark, sf_dir):
    return _stored_documents(spark, sf_dir)[0].read().select("id", "source", "source_id", "chars")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def src_9_not_indexed(spark, sf_dir):
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return _docs(spark, sf_dir).select("doc_id").join(known, "doc_id", "left_anti")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def src_10_cascade_delete(spark, sf_dir):
    left = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(left, "l_orderkey", "left_semi")


#: Foreign keys of the tables: child, its columns, parent, the columns they refer to.
LINKS = [
    ("nation", ["n_regionkey"], "region", ["r_regionkey"]), ("customer", ["c_nationkey"], "nation", ["n_nationkey"]), ("supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
    ("orders", ["o_custkey"], "customer", ["c_custkey"]), ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]), ("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]),
    ("chunks", ["doc_id"], "documents", ["doc_id"]), ("embeddings", ["vec_id"], "documents", ["doc_id"]), ("labels", ["doc_id"], "documents", ["doc_id"]), ("messages", ["conv_id"], "conversations", ["conv_id"]),
]


@query(f"""WITH {CHUNKS_SQL}, n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 3), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM n)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)), d AS (SELECT doc_id FROM documents WHERE source = 'src0'), v AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')
SELECT 'region' AS tbl, 3 AS a, NULL::BIGINT AS b UNION ALL SELECT 'nation', n_nationkey, NULL FROM n UNION ALL SELECT 'customer', c_custkey, NULL FROM c UNION ALL SELECT 'supplier', s_suppkey, NULL FROM s UNION ALL SELECT 'orders', o_orderkey, NULL FROM o
UNION ALL SELECT DISTINCT 'lineitem', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (FROM o) OR l_suppkey IN (FROM s) UNION ALL SELECT 'documents', doc_id, NULL FROM d
UNION ALL SELECT 'chunks', doc_id, chunk_index FROM chunks WHERE doc_id IN (FROM d) UNION ALL SELECT 'embeddings', vec_id, NULL FROM embeddings WHERE vec_id IN (FROM d) UNION ALL SELECT DISTINCT 'labels', doc_id, NULL::BIGINT FROM labels WHERE doc_id IN (FROM d)
UNION ALL SELECT 'conversations', conv_id, NULL FROM v UNION ALL SELECT DISTINCT 'messages', conv_id, turn FROM conversations WHERE conv_id IN (FROM v)""")
def src_10_cascade_graph(spark, sf_dir):
    """All keys that go with a region, a source and the conversations that hold a system turn: five, two and two levels, with two ways to a line."""
    named = {
        "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"],
        "documents": ["doc_id"], "embeddings": ["vec_id"], "labels": ["doc_id"],
    }
    tables = {name: (table(spark, sf_dir, name), keys) for name, keys in named.items()}
    turns = table(spark, sf_dir, "conversations")
    tables |= {"chunks": (chunks(spark, sf_dir), ["doc_id", "chunk_index"]), "conversations": (turns.select("conv_id").distinct(), ["conv_id"]), "messages": (turns, ["conv_id", "turn"])}
    doomed = {"region": tables["region"][0].filter("r_regionkey = 3"), "documents": tables["documents"][0].filter("source = 'src0'"), "conversations": turns.filter("role = 'system'")}
    out = None
    for name, keys in cascade(tables, LINKS, doomed).items():
        a, b = [*tables[name][1], None][:2]
        part = keys.select(F.lit(name).alias("tbl"), F.col(a).cast("long").alias("a"), (F.col(b) if b else F.lit(None)).cast("long").alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT page_id, CASE WHEN length(html) < 900 THEN 'fetch' WHEN NOT contains(html, '<article>') THEN 'parse' WHEN regexp_extract(html, '<title>([^<]*)', 1) = '' THEN 'title' WHEN length(html) > 20000 THEN 'chunk' END AS stage,
coalesce(length(html) < 900, false) AS retriable FROM pages""")
def ing_1_stage_validation(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "html", failing_stage(F.col("html")).alias("f")).select("page_id", F.col("f.stage").alias("stage"), F.col("f.retriable").alias("retriable"))


@query(rf"""WITH p AS (SELECT page_id, html, trim(regexp_replace({STRIP_SQL}, '\s+', ' ', 'g')) AS text, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(url, '/([0-9]+)(?:/|\.html)?(?:[?#].*)?$', 1) AS id,
  CASE WHEN contains(url, 'spam') THEN 503 WHEN contains(url, 'm.') AND contains(url, '#') THEN 404 ELSE 200 END AS status FROM pages),
c AS (SELECT page_id, CAST(greatest(ceil((length(text) - 120) / 480), CASE WHEN text <> '' THEN 1 ELSE 0 END) AS BIGINT) AS chunks, CASE WHEN page_id = min(page_id) OVER (PARTITION BY text) THEN 1 ELSE 0 END AS first FROM p),
f AS (SELECT p.*, chunks, chunks * first AS kept, CASE WHEN length(title) % 9 = 0 THEN 0 ELSE chunks * first END AS embedded FROM p JOIN c USING (page_id)),
s AS (SELECT *, CASE WHEN length(html) < 900 THEN 1 WHEN status <> 200 THEN 2 WHEN length(text) < 400 THEN 3 WHEN length(trim(title)) < 3 THEN 4 WHEN id = '' THEN 5 WHEN chunks = 0 THEN 6 WHEN kept = 0 THEN 7 WHEN embedded <> kept THEN 8 END AS n FROM f)
SELECT page_id, ['fetch-validate', 'fetch-validate', 'parse-validate', 'parse-validate', 'parse-validate', 'chunk', 'chunk', 'embed-validate'][n] AS stage,
['HTML response too short (' || length(html) || ' < 900)', 'Unexpected HTTP status code: ' || status, 'Parsed text too short (' || length(text) || ' < 400)', 'Missing parsed title', 'Missing parsed externalId', 'Chunking produced zero chunks', 'All chunks were dropped as duplicates',
'Embedded chunk count mismatch (' || embedded || ' != ' || kept || ')'][n] AS reason, n = 2 AS retriable FROM s WHERE n IS NOT NULL""")
def ing_1_page_faults(spark, sf_dir):
    """Pages that fail on their way, with stage and reason; status and vectors follow from the address and the title."""
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "html", tx.collapse_space(tx.strip_html(F.col("html"))).alias("text"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"),
        F.regexp_extract("url", r"/([0-9]+)(?:/|\.html)?(?:[?#].*)?$", 1).alias("external_id"),
        F.when(F.contains(url, F.lit("spam")), 503).when(F.contains(url, F.lit("m.")) & F.contains(url, F.lit("#")), 404).otherwise(200).alias("status"),
    )
    counted = pages.withColumn("chunks", F.greatest(F.ceil((F.length("text") - 120) / 480), F.when(F.col("text") != "", 1).otherwise(0)).cast("long"))
    # which page is the first of equal ones is told by hashes, combined before they are shuffled
    first = counted.groupBy(F.sha2("text", 256)).agg(F.min("page_id").alias("page_id")).select("page_id", F.lit(1).alias("first"))
    rows = counted.join(first, "page_id", "left").withColumn("kept", F.col("chunks") * F.coalesce("first", F.lit(0)))
    embedded = F.when(F.length("title") % 9 == 0, 0).otherwise(F.col("kept"))
    fault = page_fault(F.col("html"), F.col("status"), F.col("text"), F.col("title"), F.col("external_id"), F.col("chunks"), F.col("kept"), embedded, 900, 400)
    return rows.select("page_id", fault.alias("f")).filter("f is not null").select("page_id", "f.*")


STAGE_SQL = """CASE WHEN length(html) < {0} THEN 'fetch' WHEN NOT contains(html, '<article>') THEN 'parse' WHEN regexp_extract(html, '<title>([^<]*)', 1) = '' THEN 'title' WHEN length(html) > 20000 THEN 'chunk' END"""


@query(f"""WITH a AS (SELECT page_id, 1 AS attempt, {STAGE_SQL.format(900)} AS stage FROM pages UNION ALL SELECT page_id, 2, {STAGE_SQL.format(700)} FROM pages WHERE length(html) < 900)
SELECT page_id, stage, attempt FROM a WHERE stage IS NOT NULL AND (attempt = 2 OR stage <> 'fetch')""")
def ing_2_dead_letters(spark, sf_dir):
    """Pages that fail for good go to a dead-letter table by stage; what may be tried again is, with a smaller floor, once."""
    path = scratch(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    for attempt, least in ((1, 900), (2, 700)):
        checked = pages.withColumn("f", failing_stage(F.col("html"), least))
        final = checked.filter(F.col("f.stage").isNotNull() & (~F.col("f.retriable") | F.lit(attempt == 2)))
        final.select("page_id", F.col("f.stage").alias("stage"), F.lit(attempt).alias("attempt")).write.mode("append").partitionBy("stage").parquet(path)
        pages = checked.filter("f.retriable").select("page_id", "html")
    return spark.read.schema("page_id long, attempt int, stage string").parquet(path).select("page_id", "stage", "attempt")


@query("""SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS failed_before FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def ing_3_resume(spark, sf_dir):
    """A checkpoint is written and read back: what has a vector is completed, what has a bad label failed before; the rest is pending."""
    path = scratch(spark)
    done = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("completed").alias("state"))
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit("failed").alias("state"))
    done.unionByName(bad).write.partitionBy("state").parquet(path)
    return pending(_docs(spark, sf_dir).select("doc_id"), spark.read.parquet(path), "doc_id")


@query("""SELECT coalesce(source, '(all)') AS source, count(*) AS discovered, count(*) FILTER (length(text) >= 200) AS parsed, count(*) FILTER (length(text) < 200) AS skipped, CAST(sum(length(text)) AS BIGINT) AS chars
FROM documents GROUP BY GROUPING SETS ((source), ())""")
def ing_4_statistics(spark, sf_dir):
    n = F.length("text")
    return _docs(spark, sf_dir).select("source", n.alias("n")).rollup("source").agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("n") >= 200).alias("parsed"), F.count_if(F.col("n") < 200).alias("skipped"), F.sum("n").alias("chars"),
    ).withColumn("source", F.coalesce("source", F.lit("(all)")))


@query("""WITH e AS (SELECT user_id, event_id, (event_type = 'error')::INT AS bad, row_number() OVER w AS n, sum((event_type = 'error')::INT) OVER w AS errors, sum((event_type <> 'error')::INT) OVER w AS run
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(bad) OVER (PARTITION BY user_id, run ORDER BY n) AS streak FROM e)
SELECT user_id, CAST(min(n) AS BIGINT) AS attempt, arg_min(CASE WHEN streak >= 5 THEN 'streak' ELSE 'rate' END, n) AS reason FROM s WHERE streak >= 5 OR (n >= 10 AND errors / n > 0.3) GROUP BY user_id""")
def ing_5_fail_fast(spark, sf_dir):
    return fail_fast(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query(r"""SELECT doc_id, CASE WHEN length(t) > 3000 THEN substr(t, 1, 2100) || ' ... ' || substr(t, length(t) - 749) ELSE t END AS prepared FROM (SELECT doc_id, 'passage: ' || replace(text, chr(10), ' ') AS t FROM documents)""")
def ing_6_model_input(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", prepare_for_model(F.col("text")).alias("prepared"))


@query("""SELECT vec_id, list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE)) IS NOT NULL AS ok, len(list_concat(embedding, list_transform(range(0, 64), lambda x: 0.0::FLOAT))) AS padded,
round(list_sum(list_transform(embedding[1:48], lambda x: x::DOUBLE)), 4) AS cut_sum FROM embeddings""")
def ing_7_vector_hygiene(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", total(resized(v, 48)).isNotNull().alias("ok"), F.size(resized(v, 128)).cast("long").alias("padded"), F.round(total(resized(v, 48)), 4).alias("cut_sum")
    )


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND trim(text) <> '' AND source <> 'src0' ORDER BY doc_id LIMIT 100")
def ing_8_reembed_selection(spark, sf_dir):
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    rows = _docs(spark, sf_dir).filter("trim(text) <> '' and source <> 'src0'").select("doc_id", F.length("text").alias("chars"))
    return rows.join(have, "doc_id", "left_anti").orderBy("doc_id").limit(100)


@query("""SELECT p_type, p_partkey, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_partkey) AS rank FROM (
SELECT p_type, p_partkey, CASE WHEN contains(p_name, 'red') THEN 3 WHEN contains(p_name, 'small') THEN 2 ELSE 1 END + (p_size > 25)::INT AS score FROM part)) WHERE rank <= CASE p_type WHEN 'ECONOMY' THEN 5 ELSE 3 END""")
def ing_9_priority_seed(spark, sf_dir):
    score = F.when(F.contains("p_name", F.lit("red")), 3).when(F.contains("p_name", F.lit("small")), 2).otherwise(1) + (F.col("p_size") > 25).cast("int")
    scored = table(spark, sf_dir, "part").select("p_type", "p_partkey", score.alias("score"))
    best = top_k(scored, ["p_type"], [F.desc("score"), F.col("p_partkey")], 5)
    return best.filter(F.col("rank") <= F.when(F.col("p_type") == "ECONOMY", 5).otherwise(3))


@query("""SELECT source, doc_id, preview FROM (SELECT source, doc_id, substr(text, 1, 600) AS preview, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE length(text) >= 100) WHERE k <= 3""")
def ing_10_samples(spark, sf_dir):
    rows = _docs(spark, sf_dir).filter(F.length("text") >= 100).select("source", "doc_id", F.substring("text", 1, 600).alias("preview"))
    return top_k(rows, ["source"], [F.col("doc_id")], 3, "k").drop("k")


@query(f"""WITH {HITS}, j AS (SELECT h.query_id, h.rank, e.label = q.label AS good FROM hits h JOIN embeddings e ON h.id = e.vec_id JOIN embeddings q ON h.query_id = q.vec_id WHERE rank BETWEEN 2 AND 6)
SELECT query_id, round(count(*) FILTER (good) / 5, 3) AS precision_at_5, bool_or(good) AS hit FROM j GROUP BY query_id""")
def evl_1_retrieval(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected"))
    rows = labelled(spark, sf_dir, hits(spark, sf_dir).filter("rank between 2 and 6")).join(labels, "query_id")
    good = F.col("label") == F.col("expected")
    return rows.groupBy("query_id").agg(F.round(F.count_if(good) / 5, 3).alias("precision_at_5"), F.bool_or(good).alias("hit"))


@query(f"""WITH {HITS}, {OTHER}, c AS (SELECT o.query_id, o.id, h.id IS NOT NULL AS retrieved, e.label IN (1, 3) AS expected, e.label FROM other o LEFT JOIN hits h ON h.query_id = o.query_id AND h.id = o.id JOIN embeddings e ON o.id = e.vec_id WHERE o.rank <= 5)
SELECT query_id, accuracy, accuracy >= 0.6 AS correct FROM (SELECT query_id, round(0.7 * count(DISTINCT CASE WHEN expected THEN label END) / 2 + 0.3 * avg(retrieved::INT), 3) AS accuracy FROM c GROUP BY query_id)""")
def evl_2_citations(spark, sf_dir):
    cited = labelled(spark, sf_dir, hits(spark, sf_dir, dims=32).filter("rank <= 5"))
    found = hits(spark, sf_dir).select("query_id", "id", F.lit(True).alias("retrieved"))
    rows = cited.join(found, ["query_id", "id"], "left")
    return citation_accuracy(rows, "query_id", F.when(F.col("label").isin(1, 3), F.col("label")), 2, F.coalesce("retrieved", F.lit(False)))


#: Wording of the test tables: what counts as backing, as having nothing to say, and as the name of a law.
BACKING, NO_INFO, LAW_TITLE = r"(?i)(license|version|laut|selon)", r"(?i)(no information|nichts gefunden)", r"[A-Z][a-z]{2,} [a-z]{2,} [a-z]{2,}"
_NORMAL_SQL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
#: Replies with the turn before them, which stands for the retrieved text; its long words are what is cited.
REPLIES_SQL = rf"""replies AS (SELECT conv_id, turn, text, n, context, sources, cited, list_filter(list_transform(regexp_extract_all(text, '{LAW_TITLE}', 0), lambda x: {_NORMAL_SQL.format("x")}), lambda x: length(x) > 5 AND NOT contains(context, x))[1] AS title,
list_filter(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)*', 0), lambda x: NOT contains(context, x))[1] AS article FROM (SELECT conv_id, turn, role, text, {_NORMAL_SQL.format("text")} AS n, {_NORMAL_SQL.format("before")} AS context, (before <> '')::INT AS sources,
list_distinct(regexp_extract_all(lower(before), '[a-z]{{9,}}', 0)) AS cited FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations)) WHERE role = 'assistant')"""


def replies(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.coalesce(F.lag("text").over(w), F.lit(""))).filter("role = 'assistant'")
    return rows.withColumns({
        "n": tx.collapse_space(F.lower("text")), "context": tx.collapse_space(F.lower("before")), "sources": (F.col("before") != "").cast("int"),
        "cited": F.array_distinct(F.regexp_extract_all(F.lower("before"), F.lit("[a-z]{9,}"), F.lit(0))),
    })


@query(rf"""WITH {REPLIES_SQL}, h AS (SELECT *, n = '' AS a, sources = 0 AND n <> '' AND NOT regexp_matches(text, '{NO_INFO}') AS b,
sources > 0 AND NOT (len(cited) > 0 AND (regexp_matches(text, '{BACKING}') OR len(list_filter(cited, lambda c: contains(n, c))) > 0)) AS c, title IS NOT NULL AS d, article IS NOT NULL AS e, sources > 0 AND len(cited) = 0 AS f FROM replies),
s AS (SELECT conv_id, turn, round(greatest(0, round(1 - 0.7 * a::INT - 0.45 * b::INT - 0.2 * c::INT - 0.25 * d::INT - 0.15 * e::INT - 0.15 * f::INT, 9)), 3)::DOUBLE AS score, array_to_string(list_filter([CASE WHEN a THEN 'empty_answer' END,
CASE WHEN b THEN 'legal_claim_without_retrieved_context' END, CASE WHEN c THEN 'missing_citation_backed_wording' END, CASE WHEN d THEN 'unsupported_law_title:' || title END, CASE WHEN e THEN 'unsupported_article:' || article END,
CASE WHEN f THEN 'no_returned_citations' END], lambda x: x IS NOT NULL), ',') AS notes FROM h)
SELECT conv_id, turn, score, score >= 0.7 AS faithful, CASE WHEN notes = '' THEN 'ok' ELSE notes END AS notes FROM s""")
def evl_3_faithfulness(spark, sf_dir):
    return faithfulness(replies(spark, sf_dir), ["conv_id", "turn"], F.col("text"), F.col("context"), F.col("sources"), F.col("cited"), BACKING, NO_INFO, LAW_TITLE)


@query("""SELECT event_type, round(avg(value)) AS mean_ms, round(quantile_disc(value, 0.5)) AS p50_ms, round(quantile_disc(value, 0.95)) AS p95_ms, round(max(value)) AS max_ms FROM events WHERE value >= 0 GROUP BY event_type""")
def evl_4_latency(spark, sf_dir):
    return latency_summary(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("""SELECT user_id, count(*) AS cases, count(*) FILTER (NOT bad) AS completed, count(*) FILTER (bad OR NOT (value >= 10 AND k <> '')) AS failed, count(*) FILTER (NOT bad AND NOT value >= 10) AS failed_value,
count(*) FILTER (NOT bad AND NOT k <> '') AS failed_key, round(avg(value) FILTER (NOT bad), 4) AS mean_value, round(avg((value >= 10)::INT) FILTER (NOT bad), 4) AS mean_hit
FROM (SELECT user_id, value, event_type = 'error' AS bad, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events) GROUP BY user_id""")
def evl_5_run_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")))
    hit = F.col("value") >= 10
    return run_summary(events, ["user_id"], F.col("event_type") == "error", {"value": hit, "key": F.col("k") != ""}, {"value": F.col("value"), "hit": hit.cast("int")})


@query(f"""WITH {REPLIES_SQL} SELECT conv_id, turn, round(greatest(0, least(1, 0.3 * retrieval + 0.25 * citation + 0.3 * faith + 0.15 * latency)), 3)::DOUBLE AS overall, array_to_string(list_filter([CASE WHEN length(n) < 80 THEN 'answer_too_short' END,
CASE WHEN contains(n, 'idiot') THEN 'internal_word_leak' END, CASE WHEN citation < 0.6 THEN 'no_citations' END, CASE WHEN latency < 1 THEN 'latency_budget_exceeded' END], lambda x: x IS NOT NULL), ',') AS issues
FROM (SELECT conv_id, turn, n, len(list_filter(cited, lambda c: contains(n, c))) / greatest(len(cited), 1) AS retrieval, 1 - 0.35 * (length(n) < 80)::INT - 0.25 * contains(n, 'idiot')::INT AS faith, CASE WHEN regexp_matches(n, 'https?://') THEN 1.0 ELSE 0.55 END AS citation,
CASE WHEN length(n) <= 1000 THEN 1.0 ELSE 1000.0 / length(n) END AS latency FROM replies)""")
def evl_6_answer_quality(spark, sf_dir):
    """Retrieval is the share of the cited words that the reply takes up."""
    rows = replies(spark, sf_dir)
    text = F.col("n")
    share = F.size(F.filter("cited", lambda c: F.contains(text, c))) / F.greatest(F.size("cited"), F.lit(1))
    return answer_quality(rows, ["conv_id", "turn"], text, share, F.when(text.rlike("https?://"), 1.0).otherwise(0.55), F.length(text), 1000, ["idiot"])


#: Sources and laws of a reply are made of the words it could cite; hosts, leaks and endings are those of the test tables.
HOSTS = {"law": "law.example", "case": "case.example"}
LEAKS, UNFINISHED = (r"(?i)\bretrieval\b", r"(?i)\bthe der\b"), r"(?:the|und|la|de|of)\.?$"


@query(rf"""WITH {REPLIES_SQL}, r AS (SELECT *, list_slice(list_sort(cited), 1, 5) AS w FROM replies),
i AS (SELECT conv_id, turn, text, n, list_transform(w, lambda x: struct_pack(type := CASE WHEN length(x) % 2 = 0 THEN 'law' ELSE 'case' END, url := CASE WHEN contains(n, x) OR length(x) > 10 THEN 'https://' || CASE WHEN length(x) % 2 = 0 THEN 'www.law' ELSE 'case' END || '.example/' || x ELSE x END)) AS sources,
  list_transform(list_slice(w, 1, 3), lambda x: struct_pack(title := x, url := CASE WHEN length(x) > 9 THEN 'https://law.example/' || x ELSE ' ' END, article_no := CASE WHEN contains(x, 'e') THEN '1' ELSE '' END)) AS laws,
  CASE WHEN len(cited) > 0 THEN len(list_filter(cited, lambda x: contains(n, x))) / len(cited) END AS quality, turn > 5 AS timed_out, length(text) > 1800 AS slow, regexp_matches(text, '{NO_INFO}') AS none, length(text) * 40 AS ms FROM r),
m AS (SELECT *, len(sources) = 0 AND len(laws) = 0 AS bare, CASE WHEN len(sources) = 0 THEN 0.75 ELSE len(list_filter(sources, lambda s: regexp_extract(s.url, '^https?://([^/:?#\s]+)', 1) IN (s.type || '.example', 'www.' || s.type || '.example'))) / len(sources) END AS valid,
  CASE WHEN len(laws) = 0 THEN 0.75 ELSE len(list_filter(laws, lambda x: trim(x.title) <> '' AND trim(x.url) <> '')) / len(laws) END AS known, CASE WHEN len(laws) = 0 THEN 0.75 ELSE len(list_filter(laws, lambda x: x.article_no <> '')) / len(laws) END AS article,
  length(n) < 80 AS short, regexp_matches(text, '{"|".join(LEAKS)}') AS leak, regexp_matches(n, '{UNFINISHED}') AS ending, regexp_matches(n, '{NO_INFO}') AS said_none, ms > 25000 AS late FROM i),
p AS (SELECT *, CASE WHEN timed_out THEN greatest(0.45, coalesce(quality, 0.45)) WHEN none THEN 1 WHEN quality IS NOT NULL THEN quality WHEN bare THEN 0.45 ELSE 0.7 END AS a, CASE WHEN bare THEN 0.55 ELSE valid * 0.45 + known * 0.35 + article * 0.2 END AS b,
  1 - 0.35 * short::INT - 0.35 * said_none::INT - 0.25 * leak::INT - 0.2 * ending::INT AS c, CASE WHEN late THEN 25000 / ms ELSE 1 END AS d FROM m)
SELECT conv_id, turn, {", ".join(f"round(greatest(0, least(1, round({x}, 9))), 3)::DOUBLE AS {y}" for x, y in (("a", "retrieval"), ("b", "citation"), ("c", "faithfulness"), ("d", "latency"), ("a * 0.3 + b * 0.25 + c * 0.3 + d * 0.15", "overall")))},
array_to_string(list_filter([CASE WHEN timed_out THEN 'retrieval_timeout_fallback' END, CASE WHEN NOT timed_out AND NOT none AND quality < 0.5 THEN 'low_retrieval_quality' END, CASE WHEN NOT timed_out AND NOT none AND quality IS NULL AND bare THEN 'no_retrieval_signal' END, CASE WHEN bare THEN 'no_citations' END,
CASE WHEN NOT bare AND valid < 0.8 THEN 'invalid_source_url' END, CASE WHEN NOT bare AND article < 0.5 THEN 'weak_article_citation' END, CASE WHEN short THEN 'answer_too_short' END, CASE WHEN said_none THEN 'no_info_answer' END, CASE WHEN leak THEN 'internal_word_leak' END, CASE WHEN ending THEN 'possibly_incomplete_sentence' END,
CASE WHEN late THEN 'latency_budget_exceeded' END, CASE WHEN slow THEN 'generation_timeout_fallback' END], lambda x: x IS NOT NULL), ',') AS issues FROM p""")
def evl_6_answer_metrics(spark, sf_dir):
    """All metrics and issues of each reply; its length stands for its latency."""
    words = F.slice(F.array_sort("cited"), 1, 5)
    even = lambda w: F.length(w) % 2 == 0
    address = lambda w: F.when(F.contains(F.col("n"), w) | (F.length(w) > 10), F.concat(F.lit("https://"), F.when(even(w), "www.law").otherwise("case"), F.lit(".example/"), w)).otherwise(w)
    source = lambda w: F.struct(F.when(even(w), "law").otherwise("case").alias("type"), address(w).alias("url"))
    law = lambda w: F.struct(w.alias("title"), F.when(F.length(w) > 9, F.concat(F.lit("https://law.example/"), w)).otherwise(" ").alias("url"), F.when(F.contains(w, F.lit("e")), "1").otherwise("").alias("article_no"))
    rows = replies(spark, sf_dir)
    share = F.when(F.size("cited") > 0, F.size(F.filter("cited", lambda c: F.contains(F.col("n"), c))) / F.size("cited"))
    answers = rows.select(
        "conv_id", "turn", F.col("text").alias("answer"), F.transform(words, source).alias("sources"), F.transform(F.slice(words, 1, 3), law).alias("laws"), share.alias("retrieval_overall"), (F.col("turn") > 5).alias("retrieval_timed_out"),
        (F.length("text") > 1800).alias("generation_timed_out"), F.when(F.col("text").rlike(NO_INFO), "no-info").otherwise("context").alias("mode"), (F.length("text") * 40).alias("latency_ms"), F.lit(25_000).alias("budget_ms"),
    )
    found = quality.answer_metrics(answers, ["conv_id", "turn"], HOSTS, LEAKS, NO_INFO, UNFINISHED)
    return found.withColumn("issues", F.array_join("issues", ","))


@query(rf"""WITH {REPLIES_SQL}, v AS (SELECT *, lower(text) AS t, CASE WHEN turn > 3 THEN ['la', 'der', 'the'] ELSE ['que', 'die', 'of'] END AS must, list_concat(['idiot', 'pathetic'], CASE WHEN turn = 1 THEN ['zu zu'] ELSE [] END) AS forbidden,
len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{3,}}', 0))) AS laws, CASE WHEN turn > 3 THEN 3 ELSE 1 END AS least, len(list_filter(cited, lambda c: contains(n, c))) / greatest(len(cited), 1) AS share FROM replies),
i AS (SELECT conv_id, turn, list_filter([CASE WHEN len(list_filter(must, lambda w: contains(t, w))) = 0 THEN 'must_contain' END, CASE WHEN len(list_filter(forbidden, lambda w: contains(t, w))) > 0 THEN 'forbidden' END,
CASE WHEN regexp_matches(t, '{NO_INFO}') AND least > 0 THEN 'no_info' END, CASE WHEN laws < least THEN 'too_few_laws' END, CASE WHEN length(text) > 1500 THEN 'latency' END, CASE WHEN share < CASE WHEN turn > 3 THEN 0.01 ELSE 0.05 END THEN 'retrieval' END], lambda x: x IS NOT NULL) AS l FROM v)
SELECT conv_id, turn, len(l) = 0 AS passed, array_to_string(l, ',') AS issues FROM i""")
def evl_7_regression_gate(spark, sf_dir):
    """Expectations differ by turn; the length of a reply stands for its latency."""
    rows = replies(spark, sf_dir)
    late = F.col("turn") > 3
    some = lambda *words: F.array(*map(F.lit, words))
    must = F.when(late, some("la", "der", "the")).otherwise(some("que", "die", "of"))
    forbidden = F.concat(some("idiot", "pathetic"), F.when(F.col("turn") == 1, some("zu zu")).otherwise(F.array().cast("array<string>")))
    laws = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))))
    share = F.size(F.filter("cited", lambda c: F.contains(F.col("n"), c))) / F.greatest(F.size("cited"), F.lit(1))
    threshold = F.coalesce(F.when(late, 0.01), F.lit(0.05))
    return regression_gate(
        rows, ["conv_id", "turn"], F.lower("text"), must, forbidden, NO_INFO, laws, F.when(late, 3).otherwise(1), F.length("text"), F.lit(1500), {"retrieval": (share, threshold)}
    )


@query(f"""WITH {HITS}, {OTHER} SELECT query_id, 'chunk' AS kind, id, score, rank FROM hits UNION ALL SELECT query_id, 'law', id, NULL, rank FROM other WHERE rank <= 4 UNION ALL SELECT query_id, 'source', id, score, NULL FROM other WHERE rank <= 3""")
def evl_8_snapshot(spark, sf_dir):
    other = hits(spark, sf_dir, dims=32)
    chunk = hits(spark, sf_dir).withColumn("kind", F.lit("chunk"))
    law = other.filter("rank <= 4").drop("score").withColumn("kind", F.lit("law"))
    source = other.filter("rank <= 3").drop("rank").withColumn("kind", F.lit("source"))
    return chunk.unionByName(law, allowMissingColumns=True).unionByName(source, allowMissingColumns=True).select("query_id", "kind", "id", "score", "rank")



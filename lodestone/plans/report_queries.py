"""Corpus reports and conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import cache, quality
from lodestone.operators.rows import upsert
from lodestone.plans.registry import query, table

#: Chunks that the reports stand on: windows of 600 characters every 480.
CHUNKS_SQL = """chunks AS (SELECT doc_id, source, CAST((s - 1) / 480 AS BIGINT) AS chunk_index, substr(text, CAST(s AS BIGINT), 600) AS text
  FROM documents, unnest(range(1, greatest(length(text) - 120, 1) + 1, 480)) AS t(s))"""


def chunks(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.length("text") - 120, F.lit(1)), F.lit(480))).alias("s")
    return docs.select("doc_id", "source", "text", starts).select(
        "doc_id", "source", ((F.col("s") - 1) / 480).cast("long").alias("chunk_index"), F.expr("substring(text, s, 600)").alias("text")
    )


@query("""SELECT source, count(*) AS documents, count(quality) AS processed, max(doc_id) AS latest
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source""")
def rpt_1_documents_per_source(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count("quality").alias("processed"), F.max("doc_id").alias("latest")
    )


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def rpt_2_newest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10)


@query(f"""WITH {CHUNKS_SQL} SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, round(avg(length(text)), 2) AS mean_chars,
max(length(text)) AS max_chars, min(length(text)) AS min_chars FROM chunks""")
def rpt_3_chunk_statistics(spark, sf_dir):
    n = F.length("text")
    return chunks(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("documents"),
        F.round(F.avg(n), 2).alias("mean_chars"), F.max(n).alias("max_chars"), F.min(n).alias("min_chars"),
    )


@query(f"""WITH {CHUNKS_SQL} SELECT d.doc_id, count(c.doc_id) AS chunks, round(avg(length(c.text)), 2) AS mean_chars
FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id ORDER BY chunks DESC, d.doc_id LIMIT 10""")
def rpt_4_chunks_per_document(spark, sf_dir):
    # sizes are summed per document before the join, so no text crosses it
    sizes = chunks(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    joined = docs.join(sizes, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("chunks"), "mean_chars")
    return joined.orderBy(F.desc("chunks"), "doc_id").limit(10)


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT count(DISTINCT conv_id) AS conversations, count(*) AS messages, round(avg(n), 4) AS weighted_mean, max(n) AS most,
(SELECT round(avg(n), 4) FROM n) AS plain_mean FROM conversations JOIN n USING (conv_id)""")
def rpt_5_conversation_statistics(spark, sf_dir):
    # a mean over messages weighs a conversation by its own size: sum(n * n) / sum(n)
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(
        F.count(F.lit(1)).alias("conversations"), F.sum("n").alias("messages"),
        F.round(F.sum(F.col("n") * F.col("n")) / F.sum("n"), 4).alias("weighted_mean"),
        F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("plain_mean"),
    )


@query("SELECT conv_id, count(*) AS messages FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 10")
def rpt_6_recent_conversations(spark, sf_dir):
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))
    return counts.orderBy(F.desc("conv_id")).limit(10)


@query("SELECT role, count(*) AS n, round(avg(length(text)), 2) AS mean_chars FROM conversations GROUP BY role")
def rpt_7_messages_by_role(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 2).alias("mean_chars")
    )


@query("""SELECT event_type, k, count(*) AS n FROM (SELECT event_type, CAST(props->>'$.k' AS VARCHAR) AS k FROM events) WHERE k IS NOT NULL
GROUP BY event_type, k ORDER BY n DESC, event_type, k LIMIT 15""")
def rpt_8_most_frequent_fields(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k")).filter("k is not null")
    counts = events.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "event_type", "k").limit(15)


@query("SELECT event_id, props FROM events WHERE props IS NOT NULL AND props <> '{}' ORDER BY event_id LIMIT 5")
def rpt_9_metadata_samples(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props").filter("props is not null and props <> '{}'")
    return events.orderBy("event_id").limit(5)


@query(f"""WITH {CHUNKS_SQL} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks,
(SELECT count(*) FROM documents WHERE source = 'src0') AS hot_source, (SELECT count(*) FROM documents WHERE source <> 'src0') AS other_sources""")
def rpt_10_table_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("source") == "src0").alias("hot_source"),
        F.count_if(F.col("source") != "src0").alias("other_sources"),
    )
    pieces = chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("chunks"))
    return docs.crossJoin(pieces).select("documents", "chunks", "hot_source", "other_sources")  # one row by one row


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS messages, count(*) OVER () AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey
WHERE c_nationkey = 7 GROUP BY c_custkey, c_name ORDER BY c_custkey DESC LIMIT 20 OFFSET 10""")
def cnv_1_list_with_counts(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").filter("c_nationkey = 7").select("c_custkey", "c_name")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    listed = owners.join(counts, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("messages"))
    page = listed.orderBy(F.desc("c_custkey")).offset(10).limit(20)
    return page.crossJoin(owners.agg(F.count(F.lit(1)).alias("total")))  # by one row


@query("""SELECT conv_id, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text)::VARCHAR AS messages, count(*) AS n
FROM conversations WHERE role <> 'system' GROUP BY conv_id""".replace("::VARCHAR", "").replace(
    "list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text)",
    "string_agg(turn || ' ' || role || ' ' || text, chr(10) ORDER BY turn, role, text)",
))
def cnv_2_nested_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    nested = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    shown = F.array_join(F.transform("messages", lambda m: F.concat_ws(" ", m["turn"], m["role"], m["text"])), "\n")
    return nested.select("conv_id", shown.alias("messages"), F.size("messages").cast("long").alias("n"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')")
def cnv_3_history(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    return rows.select("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn")


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at, count(*) AS n FROM events GROUP BY user_id")
def cnv_4_last_activity(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("updated_at"), F.count(F.lit(1)).alias("n")
    )


QUESTION_SQL = r"trim(regexp_replace(regexp_replace(lower(regexp_replace({}, 'https?://\S+', ' ', 'g')), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def question_form(text):
    """Normal form of a question: no URLs, lower case, letters and digits only."""
    out = F.lower(F.regexp_replace(text, r"https?://\S+", " "))
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


@query(f"""WITH q AS (SELECT conv_id, turn, role, text, {QUESTION_SQL.format("text")} AS form,
  lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT * FROM q WHERE role = 'user')
SELECT a.conv_id, a.turn, max(b.turn) FILTER (b.next_role = 'assistant' AND trim(b.reply) <> '') AS reused_turn
FROM p a LEFT JOIN p b ON a.conv_id = b.conv_id AND a.form = b.form AND b.turn < a.turn GROUP BY a.conv_id, a.turn""")
def cnv_5_repeated_questions(spark, sf_dir):
    # the latest earlier equal question with a reply is a running maximum over the questions of one form: no self-join
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn")
    asked = rows.withColumns({"next_role": F.lead("role").over(order), "reply": F.lead("text").over(order)}).filter("role = 'user'")
    answered = (F.col("next_role") == "assistant") & (F.btrim("reply") != "")
    earlier = Window.partitionBy("conv_id", "form").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("form", question_form(F.col("text")))
    return asked.select("conv_id", "turn", F.max(F.when(answered, F.col("turn"))).over(earlier).alias("reused_turn"))


CACHE_SQL = f"""q AS (SELECT conv_id, turn, {QUESTION_SQL.format("text")} AS form FROM conversations WHERE role = 'user'),
keyed AS (SELECT *, sha256(form || chr(31) || 'v1') AS cache_key FROM q),
cache AS (SELECT cache_key, min(form) AS form, min(conv_id) AS conv_id, count(*) AS hits FROM keyed WHERE conv_id % 2 = 0 GROUP BY cache_key)"""


def keyed_questions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", question_form(F.col("text")).alias("form"))
    return rows.withColumn("cache_key", F.sha2(F.concat_ws("\x1f", "form", F.lit("v1")), 256))


def cache_table(spark, sf_dir):
    """A cache as earlier runs would have left it: the questions of even conversations."""
    old = keyed_questions(spark, sf_dir).filter("conv_id % 2 = 0")
    return old.groupBy("cache_key").agg(F.min("form").alias("form"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("hits"))


@query(f"WITH {CACHE_SQL} SELECT conv_id, turn, form, cache_key FROM keyed")
def cnv_6_cache_key(spark, sf_dir):
    return keyed_questions(spark, sf_dir).select("conv_id", "turn", "form", "cache_key")


@query(f"""WITH {CACHE_SQL} SELECT k.conv_id, k.turn, c.conv_id AS cached_from, c.hits + 1 AS hits
FROM keyed k LEFT JOIN cache c ON k.cache_key = c.cache_key AND c.hits < 100""")
def cnv_7_cache_lookup(spark, sf_dir):
    cache = cache_table(spark, sf_dir).filter("hits < 100").select("cache_key", F.col("conv_id").alias("cached_from"), "hits")
    found = keyed_questions(spark, sf_dir).join(cache, "cache_key", "left")
    return found.select("conv_id", "turn", "cached_from", (F.col("hits") + 1).alias("hits"))


@query(f"""WITH {CACHE_SQL}, fresh AS (SELECT cache_key, min(form) AS form, min(conv_id) AS conv_id FROM keyed WHERE conv_id % 3 = 0 GROUP BY cache_key)
SELECT cache_key, f.form, f.conv_id, coalesce(c.hits, 0) AS hits FROM fresh f LEFT JOIN cache c USING (cache_key)
UNION ALL SELECT cache_key, form, conv_id, hits FROM cache WHERE cache_key NOT IN (SELECT cache_key FROM fresh)""")
def cnv_8_cache_upsert(spark, sf_dir):
    fresh = keyed_questions(spark, sf_dir).filter("conv_id % 3 = 0").groupBy("cache_key").agg(
        F.min("form").alias("form"), F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("hits")
    )
    return upsert(cache_table(spark, sf_dir), fresh, ["cache_key"], keep=["hits"])


#: The log of events as that of a cache: a purchase writes an answer, a signup one under an older form of key; views, clicks and errors look answers up.
CACHE_TTL = 2 * 86_400
LOG_SQL = f"""log AS (SELECT event_id, event_type, ts, user_id, json_extract_string(props, '$.k') AS question, 'v' || (user_id % 3) AS version FROM events),
entries AS (SELECT CASE event_type WHEN 'purchase' THEN sha256(question || chr(31) || version) ELSE sha256(question || '|' || version) END AS cache_key, question, version, ts AS created_at,
  ts + INTERVAL {CACHE_TTL} SECOND AS expires_at, event_id AS answer, epoch_us(ts)::HUGEINT * 1000000000 + event_id AS o FROM log WHERE event_type IN ('purchase', 'signup')),
asked AS (SELECT event_id, ts AS asked_at, sha256(question || chr(31) || version) AS cache_key, question, version, epoch_us(ts)::HUGEINT * 1000000000 + 999999999 AS o FROM log WHERE event_type NOT IN ('purchase', 'signup')),
p AS (SELECT a.*, e.created_at AS p_created, e.expires_at > a.asked_at AS p_live, e.answer AS p_answer FROM asked a ASOF LEFT JOIN entries e ON a.cache_key = e.cache_key AND a.o >= e.o),
f AS (SELECT p.*, e.cache_key AS f_key, e.created_at AS f_created, e.expires_at > p.asked_at AS f_live, e.answer AS f_answer FROM p ASOF LEFT JOIN entries e ON p.question = e.question AND p.version = e.version AND p.o >= e.o),
found AS (SELECT event_id, asked_at, CASE WHEN p_live THEN 'primary' WHEN f_live THEN 'fallback' END AS mode, CASE WHEN p_live THEN cache_key WHEN f_live THEN f_key END AS hit_key,
  CASE WHEN p_live THEN p_answer WHEN f_live THEN f_answer END AS answer FROM f)"""


def cache_log(spark, sf_dir):
    """``asked, entries``, as ``LOG_SQL`` says."""
    log = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.get_json_object("props", "$.k").alias("question"), F.concat(F.lit("v"), F.col("user_id") % 3).alias("version"))
    key = lambda glue: F.sha2(F.concat("question", F.lit(glue), "version"), 256)
    written = log.filter("event_type in ('purchase', 'signup')").withColumn("cache_key", F.when(F.col("event_type") == "purchase", key("\x1f")).otherwise(key("|")))
    entries = cache.with_expiry(written, "ts", CACHE_TTL).select("cache_key", "question", "version", "created_at", "expires_at", F.col("event_id").alias("answer"))
    asked = log.filter("event_type not in ('purchase', 'signup')").select("event_id", F.col("ts").alias("asked_at"), key("\x1f").alias("cache_key"), "question", "version")
    return asked, entries


@query(f"""WITH {LOG_SQL} SELECT event_id, mode, answer, CASE WHEN mode IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY hit_key ORDER BY asked_at, event_id) END AS hits FROM found""")
def cnv_7_cache_as_of(spark, sf_dir):
    """What each lookup of the log found: the newest entry of its key that had not expired, else that of its question and version."""
    return cache.lookup(*cache_log(spark, sf_dir), "event_id").select("event_id", "mode", "answer", "hits")


@query(f"""WITH {LOG_SQL}, now AS (SELECT cache_key, arg_max(struct_pack(question, version, created_at, expires_at, answer), o) AS e FROM entries WHERE created_at <= TIMESTAMP '2024-01-16' GROUP BY cache_key),
h AS (SELECT hit_key, count(*) AS n, max(asked_at) AS last_hit_at FROM found WHERE hit_key IS NOT NULL AND asked_at <= TIMESTAMP '2024-01-16' GROUP BY hit_key)
SELECT cache_key, e.question AS question, e.version AS version, e.answer AS answer, coalesce(n, 0) AS hit_count, strftime(last_hit_at, '%Y-%m-%d %H:%M:%S') AS last_hit_at, e.expires_at <= TIMESTAMP '2024-01-16' AS expired FROM now LEFT JOIN h ON hit_key = cache_key""")
def cnv_8_cache_state(spark, sf_dir):
    """The cache as upserts and lookups had left it in the middle of the month."""
    asked, entries = cache_log(spark, sf_dir)
    moment = F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    state = cache.upserted(entries, cache.lookup(asked, entries, "event_id"), moment)
    return state.select("cache_key", "question", "version", "answer", "hit_count", F.date_format("last_hit_at", "yyyy-MM-dd HH:mm:ss").alias("last_hit_at"), "expired")


@query(f"""SELECT conv_id, turn, CASE WHEN role <> 'user' THEN 'not_a_question' WHEN length({QUESTION_SQL.format("text")}) < 12 THEN 'too_short'
WHEN regexp_matches(text, '[0-9]{{9,16}}') THEN 'personal_data' WHEN turn = 0 THEN NULL ELSE 'has_history' END AS reason FROM conversations""")
def cnv_9_cache_eligibility(spark, sf_dir):
    reason = (
        F.when(F.col("role") != "user", "not_a_question")
        .when(F.length(question_form(F.col("text"))) < 12, "too_short")
        .when(F.col("text").rlike("[0-9]{9,16}"), "personal_data")
        .when(F.col("turn") == 0, None)
        .otherwise("has_history")
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"))


_RISKY_SQL = " OR ".join(f"regexp_matches(text, '{p}')" for p in tx.RISKS)


@query(rf"""WITH h AS (SELECT conv_id, turn, role, text, {QUESTION_SQL.format("text")} AS form, coalesce(lag(role) OVER w, '') AS before, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT *, CASE WHEN regexp_matches(text, '[A-Z]') THEN 'legal' ELSE 'non_legal' END AS scope, CASE WHEN length(text) % 7 = 0 THEN 'unknown' ELSE 'other' END AS intent, turn > 5 AS skipped, CASE WHEN turn > 3 THEN 'reuse' ELSE 'full_refresh' END AS carry, before = 'system' AS early FROM h WHERE role = 'user'),
l AS (SELECT *, len(list_distinct(regexp_extract_all(lower(coalesce(reply, '')), '[a-z]{{9,}}', 0))) AS chunks, len(regexp_extract_all(coalesce(reply, ''), '
', 0)) AS sources, len(regexp_extract_all(coalesce(reply, ''), '[A-Z][a-z]{{3,}}', 0)) AS laws, length(reply) / 1000 AS quality FROM q)
SELECT conv_id, turn, CASE WHEN scope <> 'legal' THEN 'non_legal_scope' WHEN intent = 'unknown' THEN 'unknown_intent' WHEN skipped THEN 'follow_up_or_retrieval_skipped' WHEN carry <> 'full_refresh' THEN 'not_full_refresh' WHEN early THEN 'early_response'
WHEN length(form) < 12 OR {_RISKY_SQL} THEN 'question_not_cache_eligible_or_pii' END AS reason,
coalesce(quality, 0) >= 0.55 OR (chunks >= 2 AND sources >= 1 AND laws >= 1) AS eligible, CASE WHEN coalesce(quality, 0) >= 0.55 THEN 'quality_score' WHEN chunks >= 2 AND sources >= 1 AND laws >= 1 THEN 'grounded_context' ELSE 'low_quality_and_sparse_context' END AS kept_for FROM l""")
def cnv_9_eligibility_rules(spark, sf_dir):
    """Whether each question may be looked up, and whether what was found may be kept; the reply's length stands for its quality."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"before": F.coalesce(F.lag("role").over(w), F.lit("")), "reply": F.lead("text").over(w)}).filter("role = 'user'")
    said, text = F.coalesce("reply", F.lit("")), F.col("text")
    every = lambda pattern: F.size(F.regexp_extract_all(said, F.lit(pattern), F.lit(0)))
    reason = quality.lookup_reason(
        F.when(text.rlike("[A-Z]"), "legal").otherwise("non_legal"), F.when(F.length(text) % 7 == 0, "unknown").otherwise("other"), F.col("turn") > 5, F.when(F.col("turn") > 3, "reuse").otherwise("full_refresh"),
        F.col("before") == "system", question_form(text), tx.has_personal_data(text),
    )
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower(said), F.lit("[a-z]{9,}"), F.lit(0))))
    kept = quality.storable(F.length("reply") / 1000, words, every("\n"), every("[A-Z][a-z]{3,}"))
    return rows.select("conv_id", "turn", reason.alias("reason"), kept.alias("k")).select("conv_id", "turn", "reason", "k.eligible", F.col("k.reason").alias("kept_for"))


@query("""SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS providers, max(o_orderkey) AS latest
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def cnv_10_providers(spark, sf_dir):
    used = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.array_sort(F.collect_set("o_orderpriority")).alias("p"), F.max("o_orderkey").alias("latest")
    )
    owners = table(spark, sf_dir, "customer").select("c_custkey")
    return owners.join(used, "c_custkey", "left").select("c_custkey", F.coalesce(F.array_join("p", ","), F.lit("")).alias("providers"), "latest")


@query("""SELECT min(doc_id) AS doc_id, count(*) - 1 AS duplicates FROM documents GROUP BY sha256(text)""")
def ded_1_content_hash(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), (F.count(F.lit(1)) - 1).alias("duplicates")).drop("content_hash")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before,
  row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM l)
SELECT doc_id, count(*) FILTER (before IS DISTINCT FROM line) AS not_consecutive, count(*) FILTER (nth = 1) AS once, count(*) FILTER (nth <= 2) AS twice
FROM m GROUP BY doc_id""")
def ded_2_lines_within(spark, sf_dir):
    # counted within the row's own array: no shuffle
    lines = F.split("text", "\n", -1)
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    changes = F.size(F.filter("l", lambda x, i: (i == 0) | (F.get(F.col("l"), i - 1) != x)))
    distinct = F.array_distinct("l")
    sorted_ = F.array_sort("l")
    third = F.size(F.filter(sorted_, lambda x, i: (i >= 2) & (F.get(sorted_, i - 2) == x)))
    return docs.select(
        "doc_id", changes.alias("not_consecutive"), F.size(distinct).alias("once"), (F.size("l") - third).alias("twice")
    )


@query("""WITH old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 3),
new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4)
SELECT doc_id, CASE WHEN old.h IS NULL THEN 'new' WHEN new.h IS NULL THEN 'gone' WHEN old.h = new.h THEN 'unchanged' ELSE 'changed' END AS state
FROM old FULL JOIN new USING (doc_id)""")
def ded_3_changes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 10 <> 3").select("doc_id", F.sha2("text", 256).alias("old"))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    new = docs.filter("doc_id % 10 <> 4").select("doc_id", F.sha2(text, 256).alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return old.join(new, "doc_id", "full").select("doc_id", state.alias("state"))


@query(r"""SELECT host, min_by(url, page_id) AS first_url, count(*) AS pages, count(*) FILTER (NOT regexp_matches(url, '/[0-9]+')) AS broken
FROM (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) GROUP BY host""")
def ded_4_first_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    return pages.groupBy("host").agg(
        F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("pages"),
        F.count_if(~F.col("url").rlike("/[0-9]+")).alias("broken"),
    )


@query("""SELECT 'line' AS rule, l_orderkey || '/' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'text', sha256(text), count(*) FROM documents GROUP BY text HAVING count(*) > 1
UNION ALL SELECT 'url', url, count(*) FROM pages WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1""")
def ded_5_uniqueness(spark, sf_dir):
    def repeated(rows, rule, key):
        return rows.select(F.lit(rule).alias("rule"), key.alias("key")).filter("key is not null").groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

    lines = repeated(table(spark, sf_dir, "lineitem"), "line", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    texts = repeated(table(spark, sf_dir, "documents"), "text", F.sha2("text", 256))
    urls = repeated(table(spark, sf_dir, "pages"), "url", F.col("url"))
    return lines.unionByName(texts).unionByName(urls)




"""Page reading, models, the vector index and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import models, retrieve
from lodestone.plans import load_all
from lodestone.sources import html
from lodestone.streaming import ingest

PAGE = """<html><head><title>T</title><meta property="og:title" content="Real title"><script>var a = "<p>no</p>";</script></head><body>
<nav><p>Navigation that is long enough</p></nav><div class="ad">Buy this wonderful thing now</div>
<article><h1>Heading of it</h1><p>A paragraph of the main part, which is long enough to count &amp; more.</p>
<p>A paragraph of the main part, which is long enough to count &amp; more.</p><p>short</p><p>Unclosed <b>bold paragraph here<p>Last one of the lines.</article>
<table><tr><th>Court</th><td>First</td></tr></table><footer>All rights of the footer</footer></body></html>"""


def test_page_reading(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>loose & <"), (4, "")], "page_id long, html string")
    text = {r["page_id"]: r["text"] for r in html.clean_html(pages).collect()}
    assert text[1].split("\n\n") == ["Heading of it", "A paragraph of the main part, which is long enough to count & more.", "Unclosed bold paragraph here", "Last one of the lines."]
    assert text[2] == "" and text[4] == ""
    row = html.documents_of(pages, 1).filter("page_id = 1").first()
    assert row["title"] == "Real title" and row["fields"] == {"Court": "First"} and row["n_headings"] == 1
    assert row["text"].split("\n")[0] == "# Heading of it" and row["text"].count("A paragraph") == 1


def test_stream_gives_the_batch_result(spark, data):
    queries = load_all().QUERIES
    rows = lambda name: sorted(map(tuple, queries[name](spark, data).collect()))
    assert rows("ing_11_stream") == rows("ing_11_batch")


def test_long_texts_are_ingested_whole(spark):
    text = " ".join(f"Sentence {chr(97 + i % 26)}{chr(97 + i // 26)} ends here." for i in range(400))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert ingest.clean_batch(docs).first()["text"] == text
    rows = sorted(map(tuple, ingest.windows(ingest.clean_batch(docs)).select("char_start", "chunk").collect()))
    assert all(len(chunk) <= 600 for _, chunk in rows)
    assert rows[-1][1].endswith(text[-20:]) and rows[-1][0] + 600 >= len(text)


def deliver(spark, folder, *rows):
    """A file of documents, taken in."""
    docs = spark.createDataFrame(list(rows), "doc_id long, text string")
    docs.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    ingest.ingest(spark, f"{folder}/in", docs.schema, f"{folder}/out", f"{folder}/check")


def taken(spark, folder):
    return {r["doc_id"]: r["content_hash"] for r in ingest.documents(spark, f"{folder}/out").collect()}, sorted(r["chunk"] for r in ingest.chunk_table(spark, f"{folder}/out").collect())


def test_changed_documents_replace_their_chunks(spark, tmp_path):
    old, new, same = "the old text of a document", "the new text of a document", "a text that two documents share"
    deliver(spark, tmp_path, (1, old), (2, same), (3, "short"), (None, same))
    assert taken(spark, tmp_path)[1] == [same, old]
    deliver(spark, tmp_path, (1, new), (4, same), (3, "short"))
    versions, chunks = taken(spark, tmp_path)
    assert chunks == [same, new] and versions[2] == versions[4] and set(versions) == {1, 2, 4}
    deliver(spark, tmp_path, (1, old))  # an earlier text comes back, whose chunks are still there
    assert taken(spark, tmp_path)[1] == [same, old]
    assert ingest.held(spark, f"{tmp_path}/out", "chunks").count() == 3
    letters = {(r["doc_id"], r["stage"], r["reason"], r["attempts"]) for r in ingest.dead_letters(spark, f"{tmp_path}/out").collect()}
    assert letters == {(3, "parse-validate", "Parsed text too short (5 < 20)", 2), (None, "parse-validate", "Missing parsed externalId", 1)}


def test_a_document_whose_latest_text_is_not_valid_is_gone(spark, tmp_path):
    draft, kept = "Draft. Eser thed nt of.", "a text that stays as it is"
    deliver(spark, tmp_path, (1, draft), (2, kept))
    deliver(spark, tmp_path, (1, draft.removeprefix("Draft. ")))
    versions, chunks = taken(spark, tmp_path)
    assert set(versions) == {2} and chunks == [kept]
    deliver(spark, tmp_path, (1, draft))  # it comes back
    versions, chunks = taken(spark, tmp_path)
    assert set(versions) == {1, 2} and chunks == [draft, kept]


def test_a_content_without_chunks_is_a_version(spark, tmp_path):
    """As in the SQL of the versions, which asks for the text's length alone."""
    deliver(spark, tmp_path, (1, "the old text of a document"), (2, "a text that stays as it is"))
    deliver(spark, tmp_path, (1, "All rights reserved. " * 3))
    versions, chunks = taken(spark, tmp_path)
    assert set(versions) == {1, 2} and chunks == ["a text that stays as it is"]
    assert [r["stage"] for r in ingest.dead_letters(spark, f"{tmp_path}/out").collect()] == ["chunk"]


def test_a_killed_batch_runs_again_without_a_row_twice(spark, tmp_path):
    deliver(spark, tmp_path, (1, "the first text of a document"), (2, "another text of a document"))
    deliver(spark, tmp_path, (1, "the second text of a document"), (3, "too short"))
    before = taken(spark, tmp_path), [ingest.held(spark, f"{tmp_path}/out", name).count() for name in ingest.HELD]
    for name in ingest.HELD:  # as if the driver had been lost before it noted that the last batch was done
        commits = sorted((tmp_path / "check" / name / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        commits[-1].unlink()
        (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    docs = spark.createDataFrame([], "doc_id long, text string")
    ingest.ingest(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/out", f"{tmp_path}/check")
    assert (taken(spark, tmp_path), [ingest.held(spark, f"{tmp_path}/out", name).count() for name in ingest.HELD]) == before


def test_contents_expire_from_the_state(spark, tmp_path):
    """A content that comes again after its time is cut again, and readers take one copy."""
    docs = spark.createDataFrame([(1, "a text that comes twice"), (2, "a text to move time on")], "doc_id long, text string")
    for rows in (docs.filter("doc_id = 1"), docs.filter("doc_id = 2"), docs.filter("doc_id = 2"), docs.filter("doc_id = 1")):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/out", f"{tmp_path}/check", keep="0 seconds")
    assert ingest.held(spark, f"{tmp_path}/out", "chunks").filter("chunk like '%twice'").count() == 2
    assert taken(spark, tmp_path)[1] == ["a text that comes twice", "a text to move time on"]


def test_streams_do_not_read_what_they_wrote(spark, tmp_path):
    deliver(spark, tmp_path, (1, "the first text of a document"))
    fed = ingest.sinks(ingest.deliveries(spark, f"{tmp_path}/in", spark.createDataFrame([], "doc_id long, text string").schema, None), "1 day")
    for rows in fed.values():
        assert "/out" not in rows._jdf.queryExecution().toString() and rows.isStreaming


def test_index_recall(spark):
    items = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    questions = items.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in retrieve.vector_top_k(questions, items, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in models.indexed_top_k(questions, items, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_vector_search_in_blocks(spark, monkeypatch):
    items = spark.range(200).select("id", F.array(*(F.sin(F.col("id") * k) for k in range(1, 6))).alias("vector"))
    questions = items.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    whole = sorted(map(tuple, retrieve.vector_top_k(questions, items, 5).collect()))
    monkeypatch.setattr(retrieve, "QUESTION_BLOCK", 3)
    blocks = retrieve.vector_top_k(questions, items.repartition(7), 5)
    assert sorted(map(tuple, blocks.collect())) == whole and len(whole) == 100


def test_models_are_pluggable(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "b a")], "k long, t string")
    vectors = {r["k"]: r["vector"] for r in models.embed(rows, "k", "t").collect()}
    assert vectors[1] == vectors[3] and set(vectors[2]) == {0.0} and abs(np.linalg.norm(vectors[1]) - 1) < 1e-9
    with pytest.raises(Exception, match="another number"):
        models.embed(rows, "k", "t", lambda texts: np.zeros((1 + len(texts), 2))).collect()


def test_a_failing_cross_encoder_changes_nothing(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, 1, "q", "x"), (1, 2, 0.4, 2, "q", "q")], "query_id long, id long, score double, rank int, q string, t string")

    def broken(questions, texts):
        raise RuntimeError

    same = models.cross_encoder_blend(hits, "q", "t", broken).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["model_failed"]) for r in same] == [(1, 0.5, True), (2, 0.4, True)]
    short = models.cross_encoder_blend(hits, "q", "t", lambda q, t: np.zeros(len(q) + 1))
    assert short.filter("model_failed").count() == 2
    new = models.cross_encoder_blend(hits, "q", "t", models.word_overlap).orderBy("rank").collect()
    assert [(r["id"], r["score"], r["model_failed"]) for r in new] == [(2, 0.64, False), (1, 0.3, False)]

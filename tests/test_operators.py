"""Operators on small literals."""

from pyspark.sql import functions as F

from lodestone.functions import parse, text
from lodestone.operators import chunk, evaluate, models, retrieve, rows
from lodestone.sources.jsonl import read_jsonl
from lodestone.sources.pages import page_files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_normalize(spark):
    t = F.col("t")
    assert one(spark, text.normalize_text(t), t="é a b​") == "é ab".replace("ab", "a b")
    assert one(spark, text.normalize_text(t), t="14.7 x") == "14. 7 x"
    assert one(spark, text.normalize_text(t, False), t="14.7 x\n\n\n\n y ") == "14.7 x\n\ny"
    assert one(spark, text.normalize_text(t), t=None) is None


def test_sentence_cut(spark):
    t = F.col("t")
    assert one(spark, text.truncate_at_sentence(t, 20), t="One two. Three four five six") == "One two. Three four".removesuffix(" four") + " four"
    assert one(spark, text.truncate_at_sentence(t, 20), t="One two three. Four five") == "One two three."
    assert one(spark, text.truncate_at_sentence(t, 20), t="short") == "short"


def test_article_numbers(spark):
    t = F.col("t")
    assert one(spark, parse.article_number(t), t="see article 501") is None
    assert one(spark, parse.article_number(t), t="see article 25.1") == "25.1"
    assert one(spark, parse.law_ids(t), t="1985/12 2001-003 2001/003") == ["2001/003"]


def test_latency(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1000, 3000, 5000, 7000, 9000, -1)], "k int, v double")
    assert tuple(evaluate.latency_summary(df, ["k"], "v").first()) == (1, 5000, 5000, 9000, 9000)


def reference_pack(parts, most, overlap, glue, least=0):
    done, held = [], ""
    for part in parts:
        joined = part if held == "" else held + glue + part
        if len(joined) > most and held != "":
            if len(held) >= least:
                done.append(held)
            held = (held if len(held) <= overlap else held[-overlap:]) + glue + part
        else:
            held = joined
    return done + [held] if held.strip() and len(held) >= least else done


def test_packing_matches_a_plain_loop(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60)
    want = []
    for doc, t in docs.collect():
        parts = [p for p in t.split("\n") if p.strip(" ")]
        want += [(doc, i, c) for i, c in enumerate(reference_pack(parts, 2400, 256, "\n\n", 197))]
    got = [tuple(r)[:3] for r in chunk.pack_paragraphs(docs, mark="\n").collect()]
    assert sorted(got) == sorted(want)


def test_merge_small_matches_a_plain_loop(spark):
    lines = [(1, i, "x" * n) for i, n in enumerate([300, 50, 199, 300, 20, 20, 500, 150])] + [(2, 0, "y")]
    df = spark.createDataFrame(lines, "d int, p int, t string")
    want, before = [], {}
    for d, _, t in lines:
        mine = before.setdefault(d, [])
        if mine and len(t) < 200 and len(mine[-1]) + len(t) < 600:
            mine[-1] += "\n" + t
        else:
            mine.append(t)
    want = [(d, i, t) for d, mine in before.items() for i, t in enumerate(mine)]
    assert sorted(map(tuple, chunk.merge_small(df, ["d"], "p", "t").collect())) == sorted(want)


def test_upsert_keeps_old_values(spark):
    base = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "k int, v string, id string")
    delta = spark.createDataFrame([(2, "B", "new"), (3, "c", "new")], "k int, v string, id string")
    got = sorted(map(tuple, rows.upsert(base, delta, ["k"], keep=["id"]).collect()))
    assert got == [(1, "a", "old"), (2, "B", "old"), (3, "c", "new")]


def test_keep_unless_empty(spark):
    df = spark.createDataFrame([(1, 1), (1, 5), (2, 1), (2, 2)], "q int, s int")
    assert sorted(map(tuple, rows.keep_unless_empty(df, ["q"], F.col("s") > 3).collect())) == [(1, 5), (2, 1), (2, 2)]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "t": "x"}\n\n{"id": "2"}\n{bad\n')
    got = sorted((r["value"], r["error"]) for r in read_jsonl(spark, str(tmp_path), ["id", "t"]).collect())
    assert got == [('{"id": "1", "t": "x"}', None), ('{"id": "2"}', "missing_t"), ("{bad", "bad_json")]


def test_clauses_extend_the_article_and_letters_cut_them(spark):
    articles = [
        (1, 1, None, "Article 25. Contact", "Article 25. Contact\n25.1. Parents who live apart keep their right.\n25.2. Visits are to be made possible.\n26.1. is another article's number and stays.\n25.3. Disputes go to couretrieve."),
        (1, 2, "PART ONE", "Article 43. Rights", "Article 43. Rights\n43.1 A worker has the right to:\n\u0430/ work in a safe place of work;\n\u0431/ be paid for the work done;\n43.2 A worker has the duty to:\n\u0430/ keep the rules of the house;\n\u0431/ short;\n43.3 Nothing else is asked of anyone."),
        (1, 3, None, "Article 7. Short", "Article 7. Short\n7.1 one clause of two\n7.2 the other clause"),
    ]
    df = spark.createDataFrame(articles, "doc_id long, article_index long, chapter string, heading string, body string")
    rows = chunk.legal_pieces(df, ["doc_id", "article_index"], F.regexp_extract("heading", "([0-9]+)", 1)).collect()
    found = {(r["article_index"], r["kind"], r["clause_no"], r["subclause_no"]): r["piece"] for r in rows}
    assert set(found) == {
        (1, "clause", "25.1", None), (1, "clause", "25.2", None), (1, "clause", "25.3", None),
        (2, "subclause", "43.1", "43.1.\u0430"), (2, "subclause", "43.1", "43.1.\u0431"), (2, "subclause", "43.2", "43.2.\u0430"), (2, "subclause", "43.2", "43.2.\u0431"), (2, "clause", "43.3", None),
        (3, "article", None, None),
    }
    assert found[1, "clause", "25.2", None] == "Article 25. Contact\n25.2. Visits are to be made possible.\n26.1. is another article's number and stays."
    assert found[2, "subclause", "43.1", "43.1.\u0431"] == "Article 43. Rights\n43.1 A worker has the right to:\n\u0431/ be paid for the work done;"
    assert {r["heading_path"] for r in rows if r["subclause_no"] == "43.2.\u0430"} == {"PART ONE > Article 43. Rights > 43.2 > 43.2.\u0430"}


def test_faithfulness_of_literal_answers(spark):
    cited = ["labour law of the land", "78"]
    rows = [
        (1, "The Labour Law of the land, article 78, tells.", "labour law of the land article 78", 1, cited),
        (2, "The Labour Law article 78 applies. The Criminal Law 17.1 as well.", "labour law article 78", 1, cited),
        (3, "Civil Law 497 lets you claim the damage.", "", 0, []),
        (4, "", "labour law", 1, []),
        (5, "We found no information.", "", 0, []),
    ]
    df = spark.createDataFrame(rows, "i long, answer string, context string, sources int, cited array<string>")
    got = {r["i"]: (r["score"], r["faithful"], r["notes"]) for r in evaluate.faithfulness(df, ["i"], F.col("answer"), F.col("context"), F.col("sources"), F.col("cited"), "(?i)according|law", "(?i)no information", "(?:Criminal|Labour|Civil) Law").collect()}
    assert got[1] == (1.0, True, "ok")
    assert got[2] == (0.6, False, "unsupported_law_title:criminal law,unsupported_article:17.1")
    assert got[3] == (0.15, False, "legal_claim_without_retrieved_context,unsupported_law_title:civil law,unsupported_article:497")
    assert got[4] == (0.0, False, "empty_answer,missing_citation_backed_wording,no_returned_citations")
    assert got[5] == (1.0, True, "ok")


def test_latency_of_literal_runs(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1000, 3000, 5000, 7000, 9000, -1)], "k long, v double")
    assert tuple(evaluate.latency_summary(df, ["k"], "v").first()) == (1, 5000, 5000, 9000, 9000)


def test_dates_and_confidence(spark):
    texts = ["of 2024.5.3 and 2023-01-02.", "on 2024-5-3", "2031 year 4 month 9", "x2024-01-02", "2024-01-02T", "", None, "2024.12.31, 2020.1.1", "2024 year 4-5"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", parse.iso_date(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in sorted(rows)] == ["2023-01-02", "", "2031-04-09", "", "", "", "", "2024-12-31", ""]
    texts = ["so.\nConfidence: 0.75 \n", "confidence:3", "Confidence: high", "confidence: 0.2 or so", "ratio: 0.9", "0.9"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", parse.confidence(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in sorted(rows)] == [0.75, 1.0, 0.5, 0.5, 0.5, 0.5]


def test_trigram_search_over_parts_and_containment(spark):
    docs = spark.createDataFrame([(1, "nothing of the kind"), (1, "The Quick Brown Fox jumps"), (2, "a quick brown foxes den " + "with much more text around it " * 9), (3, "slow")], "id long, text string")
    asked = spark.createDataFrame([(7, "quick brown fox"), (8, "")], "query_id long, text string")
    hits = {(r["query_id"], r["id"]): r["score"] for r in retrieve.trigram_search(asked, docs, "id", "text", 5).collect()}
    assert set(hits) == {(7, 1), (7, 2)} and hits[7, 1] > 0.3 > hits[7, 2]


def test_index_finds_what_exact_search_finds(spark):
    items = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = items.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in retrieve.vector_top_k(asked, items, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in models.indexed_top_k(asked, items, 10).collect()}
    assert len(exact) >= 400 and len(exact & found) >= 0.9 * len(exact)


def test_files_of_pages(spark, tmp_path):
    (tmp_path / "12.html").write_text("<p>first page\nof two lines</p>")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x-7.html").write_text("short")
    rows = {r["external_id"]: r["value"] for r in page_files(spark, f"file://{tmp_path}").collect()}
    assert rows == {"12": "<p>first page\nof two lines</p>", "x-7": "short"}
    assert page_files(spark, f"file://{tmp_path}", least=10).count() == 1

"""Answer metrics on literal answers, cache eligibility, and articles that hits back."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import quality

ANSWERS = (
    "k long, answer string, sources array<struct<type:string,url:string>>, laws array<struct<title:string,url:string,article_no:string>>, retrieval_overall double, retrieval_timed_out boolean, generation_timed_out boolean, mode string, "
    "latency_ms long, budget_ms long"
)
HOSTS = {"legalinfo": "legalinfo.mn", "shuukh": "shuukh.mn"}
LEAKS = (r"(?i)\bretrieval\b", r"(?i)\brerank", r"(?i)\bchunk\b", r"(?i)\bscore\b", r"(?i)контекстэд\s+давтагдсан")
URL = "https://legalinfo.mn/mn/detail?lawId=299&article=451"
GROUNDED = "Банкнаас зээл авахдаа гэрээний хүү, нэмэгдүүлсэн хүү, шимтгэл, барьцааны нөхцөлийг бичгээр шалгах хэрэгтэй. Хэрэв ойлгомжгүй нөхцөл байвал гарын үсэг зурахаас өмнө банкнаас тайлбар авна."
LEAKING = "Контекстэд давтагдсан source score өндөр тул энэ retrieval result дээр тулгуурлана."


@pytest.fixture(scope="module")
def found(spark):
    law = ("Иргэний хууль §451", URL, "451")
    rows = [
        (1, GROUNDED, [("legalinfo", URL)], [law], 0.9, None, None, "context", 4500, 25000), (2, LEAKING, [], [], None, None, None, "context", 90000, 25000),
        (3, GROUNDED, [("legalinfo", "https://www.legalinfo.mn/x"), ("legalinfo", "https://evil-legalinfo.mn/x"), ("shuukh", URL), ("other", URL), ("legalinfo", None)], [("t", " ", ""), law, ("x", URL, None)], 0.4, None, True, "context", 500, 100),
        (4, "Мэдээлэл олдсонгүй", None, None, None, None, None, "no-info", 1001, 0), (5, None, None, None, 0.2, True, None, None, None, 25000), (6, GROUNDED + " гэсэн", [("shuukh", "https://shuukh.mn/1")], None, None, False, False, "context", 1, 1),
    ]
    out = quality.answer_metrics(spark.createDataFrame(rows, ANSWERS), ["k"], HOSTS, LEAKS, r"мэдээлэл\s+олдсонгүй", r"(?:нь|бол|болон|эсхүл|гэсэн|тул|учир)$")
    return {r["k"]: r for r in out.collect()}


def test_a_grounded_answer_scores_highly(found):
    one = found[1]
    assert one["overall"] == 0.97 and one["overall"] > 0.85 and one["issues"] == []
    assert (one["retrieval"], one["citation"], one["faithfulness"], one["latency"]) == (0.9, 1.0, 1.0, 1.0)


def test_leaks_missing_citations_and_latency_cost(found):
    two = found[2]
    assert two["overall"] < 0.65 and {"internal_word_leak", "latency_budget_exceeded", "no_citations", "no_retrieval_signal"} <= set(two["issues"])
    assert (two["citation"], two["retrieval"], two["latency"]) == (0.55, 0.45, 0.278)


def test_citations_are_weighed(found):
    three = found[3]
    assert three["citation"] == pytest.approx(0.45 / 5 + 0.35 * 2 / 3 + 0.2 / 3, abs=1e-3)
    assert three["issues"] == ["low_retrieval_quality", "invalid_source_url", "weak_article_citation", "generation_timeout_fallback"]  # the budget is 1,000 at least


def test_answers_without_information_and_nulls(found):
    assert (found[4]["retrieval"], found[4]["faithfulness"]) == (1.0, 0.3) and found[4]["issues"] == ["no_citations", "answer_too_short", "no_info_answer", "latency_budget_exceeded"]
    assert found[5]["retrieval"] == 0.45 and found[5]["issues"][0] == "retrieval_timeout_fallback"
    assert found[6]["retrieval"] == 0.7 and found[6]["citation"] == pytest.approx(0.45 + 0.55 * 0.75, abs=1e-3) and found[6]["issues"] == ["possibly_incomplete_sentence"]


def test_reasons_come_in_order(spark):
    rows = [
        (0, "legal", "fine", False, "full_refresh", False, "a question long enough", False), (1, None, "unknown", True, "x", True, "", True), (2, "legal", "unknown", True, "x", True, "", True),
        (3, "legal", "fine", True, "x", True, "", True), (4, "legal", "fine", None, "x", True, "", True), (5, "legal", "fine", None, "full_refresh", True, "", True), (6, "legal", "fine", None, "full_refresh", None, "short", None), (7, "legal", "fine", None, "full_refresh", None, "a question long enough", True),
    ]
    df = spark.createDataFrame(rows, "k long, scope string, intent string, skipped boolean, carry string, early boolean, form string, risky boolean")
    args = [F.col(c) for c in df.columns[1:]]
    assert [r["r"] for r in df.orderBy("k").select(quality.lookup_reason(*args).alias("r")).collect()] == [
        None, "non_legal_scope", "unknown_intent", "follow_up_or_retrieval_skipped", "not_full_refresh", "early_response", "question_not_cache_eligible_or_pii", "question_not_cache_eligible_or_pii",
    ]
    assert df.select(quality.lookup_reason(*args, enabled=False).alias("r")).distinct().first()["r"] == "cache_disabled"


def test_results_are_kept_by_quality_or_context(spark):
    df = spark.createDataFrame([(0.55, 0, 0, 0), (0.54, 2, 1, 1), (0.54, 1, 9, 9), (None, None, None, None)], "q double, c int, s int, l int")
    found = [tuple(r["k"]) for r in df.select(quality.storable(F.col("q"), F.col("c"), F.col("s"), F.col("l")).alias("k")).collect()]
    assert found == [(True, "quality_score"), (True, "grounded_context"), (False, "low_quality_and_sparse_context"), (False, "low_quality_and_sparse_context")]


def test_articles_are_allowed_by_the_sum_of_scores(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, ["7", "8"]), (1, 2, 0.4, ["8", "8"]), (1, 3, None, ["9", ""]), (1, 4, 0.05, ["10"]), (1, 5, 0.0, ["3"]), (1, 7, 0.9, ["99"]), (2, 1, 0.9, None)], "q long, rank int, score double, a array<string>")
    allowed = quality.allowed_articles(hits, "q", F.col("a"), F.col("score"), F.col("rank"))
    assert [tuple(r) for r in allowed.collect()] == [(1, ["8", "7", "10", "3"])]
    answers = spark.createDataFrame([(1, ["8", "99", "8"]), (3, ["1"])], "q long, said array<string>")
    assert sorted((r["q"], r["ungrounded"]) for r in quality.ungrounded(answers, "q", F.col("said"), allowed).collect()) == [(1, ["99"]), (3, ["1"])]

"""References between articles, resolved by what was named before."""

from pyspark.sql import functions as F

from lodestone.operators import references as rf
from lodestone.operators import sections
from lodestone.operators.sections import Grammar


def mentioned(spark, text, law="1990/10", article="7", most=12):
    row = spark.createDataFrame([(law, article, text)], "law string, article string, t string")
    return [tuple(e) for e in row.select(rf.mentioned(F.col("t"), F.col("law"), F.col("article"), rf.Wording(), most).alias("e")).first()["e"]]


def test_relative_references_take_the_law_named_before(spark):
    text = "By article 3 and 4.1. Law 2001/75, Article 5, and clause 6.2.1 of it; this law, article 8; this article; LAW 2002/12 article 9."
    assert mentioned(spark, text) == [
        ("1990/10", "3", ""), ("1990/10", "4", "4.1"), ("2001/75", "5", ""), ("2001/75", "6", "6.2.1"), ("1990/10", "8", ""), ("1990/10", "7", ""), ("2002/12", "9", ""),
    ]
    assert mentioned(spark, None) == [] == mentioned(spark, "no reference in 2001/75 or 12 days")
    assert mentioned(spark, "this article", article=None) == [] and mentioned(spark, "article 3, article 3, 4.1", law=None) == [("", "3", ""), ("", "4", "4.1")]
    assert len(mentioned(spark, " ".join(f"article {i}" for i in range(40)))) == 12


def test_edges_end_at_articles_that_there_are(spark):
    rows = [("1", "1", "article 2, article 9, this article, Law 2001/11 article 1"), ("1", "2", "article 1"), ("2001/11", "1", "Law 1 article 2, this law, 2.5"), ("2001/11", "2", "Law 2001/11 article 1"), ("x", "1", None)]
    articles = spark.createDataFrame(rows, "law string, article string, t string")
    found = rf.edges(articles, "t")
    assert sorted(map(tuple, found.collect())) == [
        ("1", "1", "1", "2", "", True), ("1", "1", "1", "9", "", False), ("1", "1", "2001/11", "1", "", True), ("1", "2", "1", "1", "", True),
        ("2001/11", "1", "2001/11", "2", "", True), ("2001/11", "1", "2001/11", "2", "2.5", True), ("2001/11", "2", "2001/11", "1", "", True),
    ]
    near = {(r["law"], r["article"]): r["related"] for r in rf.related(found).collect()}
    assert near[("1", "1")] == ["2001/11 1", "1 2"] and near[("1", "2")] == ["1 1"]  # 2001/11 1 is referred to twice


def test_articles_are_assembled_with_their_parts(spark):
    grammar = Grammar(article=r"^Article ([0-9]+)\.\s*(.*)$", chapter=r"^CHAPTER ")
    text = "CHAPTER A\nArticle 1. One\n1.1 see  article 5\na) first\n1.2 Repealed.\nArticle 2.\nonly text, article 1, article 1, article 2, article 3, article 4, article 5, article 6"
    rows = sections.article_rows(spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string"), grammar).collect()
    one, two = rows
    assert (one["article_no"], one["title"], one["chapter"], one["numbers"], one["amendments"]) == ("1", "One", "CHAPTER A", ["1.1", "1.1.a", "1.2"], ["1.2 Repealed."])
    assert one["texts"] == ["1.1 see  article 5\na) first", "a) first", "1.2 Repealed."] and one["references"] == ["Article 1", "article 5"]
    assert two["title"] == "" and two["body"].startswith("Article 2.\nonly") and len(two["references"]) == 5

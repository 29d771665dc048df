"""References between articles: what a text refers to, resolved to law and article.

A reference may name its law, or stand for one named before it ("article 3" after
"Law 2001/75"), or for the law and article that it stands in ("this article").
The mentions of a text are folded in order with the law in force as state; edges
then meet the articles there are by their keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A value that must match: references of a text.
MOST_EDGES = 12
KEY = ["law", "article"]


@dataclass(frozen=True)
class Wording:
    """How a text names a law (with its key as group), the law and article it belongs to, and an article (with its number as group); bare numbers with full stops are clauses."""

    law: str = r"(?i)^law\s+([0-9]{4}/[0-9]{2,3})$"
    this_law: str = r"(?i)^this law$"
    this_article: str = r"(?i)^this article$"
    article: str = r"(?i)^(?:article\s+)?([0-9]+(?:\.[0-9]+)*)$"
    mention: str = r"(?i)\blaw\s+[0-9]{4}/[0-9]{2,3}\b|\bthis (?:law|article)\b|\barticle\s+[0-9]+(?:\.[0-9]+)*|\b[0-9]+(?:\.[0-9]+)+\b"


def mentioned(text: Column, law: Column, article: Column, wording: Wording, most: int = MOST_EDGES) -> Column:
    """The first ``most`` distinct ``struct(law, article, clause)`` that a text of ``law`` and ``article`` refers to, in order; ``clause`` is empty for whole articles."""
    edge = lambda to, number, clause: F.struct(to.alias("law"), number.alias("article"), clause.alias("clause"))
    none = F.array().cast("array<struct<law:string,article:string,clause:string>>")
    start = F.struct(F.coalesce(law.cast("string"), F.lit("")).alias("law"), none.alias("edges"))

    def step(state: Column, said: Column) -> Column:
        named, number = F.regexp_extract(said, wording.law, 1), F.regexp_extract(said, wording.article, 1)
        own = said.rlike(wording.this_law) | said.rlike(wording.this_article)
        now = F.when(named != "", named).when(own, start["law"]).otherwise(state["law"])
        clause = F.when(F.contains(number, F.lit(".")), number).otherwise("")
        new = F.when(said.rlike(wording.this_article) & article.isNotNull(), F.array(edge(start["law"], article.cast("string"), F.lit("")))).when(number != "", F.array(edge(now, F.substring_index(number, ".", 1), clause))).otherwise(none)
        return F.struct(now.alias("law"), F.array_union(state["edges"], new).alias("edges"))

    every = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(wording.mention), F.lit(0))
    return F.slice(F.aggregate(every, start, step, lambda s: s["edges"]), 1, most)


def edges(articles: DataFrame, text: str, wording: Wording | None = None, most: int = MOST_EDGES) -> DataFrame:
    """``law, article, to_law, to_article, to_clause, resolved``: what each of ``articles(law, article, text)`` refers to, and whether there is such an article.

    Only keys meet; a reference to the text's own article is no edge.
    """
    found = articles.select(*KEY, F.explode(mentioned(F.col(text), F.col("law"), F.col("article"), wording or Wording(), most)).alias("e"))
    rows = found.select(*KEY, F.col("e.law").alias("to_law"), F.col("e.article").alias("to_article"), F.col("e.clause").alias("to_clause"))
    rows = rows.filter((F.col("law") != F.col("to_law")) | (F.col("article") != F.col("to_article"))).distinct()
    known = articles.select(F.col("law").alias("to_law"), F.col("article").alias("to_article")).distinct().withColumn("known", F.lit(True))
    return rows.join(known, ["to_law", "to_article"], "left").select(*KEY, "to_law", "to_article", "to_clause", F.coalesce("known", F.lit(False)).alias("resolved"))


def related(found: DataFrame, most: int = 5) -> DataFrame:
    """``law, article, related``: the articles that an article refers to and that there are, by number of references to them from anywhere, the first ``most``."""
    there = found.filter("resolved").select(*KEY, "to_law", "to_article").distinct()
    weight = there.groupBy("to_law", "to_article").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "to_law", "to_article")))
    ranked = there.join(weight, ["to_law", "to_article"]).groupBy(*KEY).agg(order.alias("o"))
    return ranked.select(*KEY, F.slice(F.transform("o", lambda x: F.concat_ws(" ", x["to_law"], x["to_article"])), 1, most).alias("related"))

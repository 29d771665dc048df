"""Document tables to chunk tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import collapse_space

#: Values that must match: characters of a chunk, of the overlap of two, and below which a piece joins its neighbour.
MAX_CHARS, OVERLAP_CHARS, MERGE_CHARS = 600, 120, 200


def windows(docs: DataFrame, text: str = "text", most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Fixed-stride windows: columns of ``docs`` without the text, and ``chunk_index, char_start, chunk``; the last window ends at the text's end."""
    stride = max(1, most - overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(stride))
    others = [c for c in docs.columns if c != text]
    cut = docs.select(*others, text, F.posexplode(starts).alias("chunk_index", "char_start"))
    chunk = F.trim(F.expr(f"substring({text}, char_start + 1, {most})"))
    return cut.select(*others, "chunk_index", "char_start", chunk.alias("chunk")).filter("chunk <> ''")


def lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def places(lines: Column, opens: Callable[[Column], Column], first: int = 0) -> Column:
    """Indices of the lines, from ``first`` on, for which ``opens`` holds."""
    every = F.when(F.size(lines) > first, F.sequence(F.lit(first), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda i: opens(F.trim(F.get(lines, i))))


def part(lines: Column, at: Column, k: Column) -> Column:
    """Lines of part ``k``: from the k-th place of ``at`` to the next one; part 0 is what stands before the first."""
    start = F.when(k == 0, 0).otherwise(F.get(at, k - 1))
    end = F.when(k < F.size(at), F.get(at, k)).otherwise(F.size(lines))
    return F.slice(lines, start + 1, end - start)


def segments(docs: DataFrame, article: str, chapter: str, doc_id: str = "doc_id", text: str = "text", least: int = 20, preamble: int = MERGE_CHARS) -> DataFrame:
    """Articles: ``doc_id, article_index, chapter, heading, body``.

    A line that matches ``article`` opens an article, which runs to the next
    one; its chapter is the last line before it that matches ``chapter``.  The
    text before the first article is article 0, kept from ``preamble``
    characters on; articles below ``least`` characters are dropped.  A document
    is cut within its row: nothing is shuffled.
    """
    cut = docs.select(F.col(doc_id), F.split(text, "\n", -1).alias("lines"))
    marked = cut.withColumns({"at": places(F.col("lines"), lambda x: x.rlike(article)), "chapters": places(F.col("lines"), lambda x: x.rlike(chapter))})
    lines, at, chapters = F.col("lines"), F.col("at"), F.col("chapters")

    def one(k: Column) -> Column:
        start = F.get(at, k - 1)
        above = F.array_max(F.filter(chapters, lambda c: c <= start))
        return F.struct(
            k.cast("long").alias("article_index"),
            F.when(k > 0, F.trim(F.get(lines, above))).alias("chapter"),
            F.when(k > 0, F.trim(F.get(lines, start))).alias("heading"),
            F.array_join(part(lines, at, k), "\n").alias("body"),
        )

    rows = marked.select(doc_id, F.explode(F.transform(F.sequence(F.lit(0), F.size(at)), one)).alias("s")).select(doc_id, "s.*")
    kept = F.length(F.trim("body")) >= F.when(F.col("article_index") == 0, preamble).otherwise(least)
    return rows.filter(kept).withColumn("body", F.btrim("body", F.lit(" \n")))


def sections(docs: DataFrame, article: str, chapter: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, section, body``: documents without articles, cut at chapter lines; section 0 is what stands before the first."""
    cut = docs.select(F.col(doc_id), F.split(text, "\n", -1).alias("lines")).filter(~F.exists("lines", lambda x: F.trim(x).rlike(article)))
    marked = cut.withColumn("at", places(F.col("lines"), lambda x: x.rlike(chapter)))
    parts = F.transform(F.sequence(F.lit(0), F.size("at")), lambda k: F.struct(k.cast("long").alias("section"), part(F.col("lines"), F.col("at"), k).alias("own")))
    rows = marked.select(doc_id, F.explode(parts).alias("s")).filter(F.size("s.own") > 0)
    return rows.select(doc_id, "s.section", F.array_join("s.own", "\n").alias("body"))


#: Values that must match: a clause number at the start of a line; a local number or a letter before a slash, full stop or bracket.
CLAUSE_START = r"^([0-9]+(?:\.[0-9]+){1,3})\.?\s"
LABEL_START = r"^([0-9]+|\p{L})(?:[.)]|/)\s"


def clauses(articles: DataFrame, keys: list[str], clause: str = CLAUSE_START, body: str = "body", fewest: int = 3, most: int = MAX_CHARS, extends: Column | None = None, first: int = 0) -> DataFrame:
    """Articles with ``fewest`` clauses or over ``most`` characters split at clause lines: keys, ``clause_index, clause_no, clause``; others whole.

    With ``extends``, the number of the article, a clause's number must go on
    from it.  Lines before ``first`` open no clause.
    """

    def opens(line: Column) -> Column:
        number = F.regexp_extract(line, clause, 1)
        return (number != "") & (F.startswith(number, F.concat(F.col("__number"), F.lit("."))) if extends is not None else F.lit(True))

    rows = articles.select(*keys, F.length(body).alias("__chars"), F.split(body, "\n", -1).alias("__lines"), (F.lit(None).cast("string") if extends is None else extends.cast("string")).alias("__number"))
    marked = rows.withColumn("__at", places(F.col("__lines"), opens, first))
    lines, at = F.col("__lines"), F.col("__at")
    splits = (F.size(at) >= fewest) | (F.col("__chars") > most)

    def one(k: Column) -> Column:
        number = F.when(k > 0, F.regexp_extract(F.trim(F.get(lines, F.get(at, k - 1))), clause, 1))
        return F.struct(k.cast("long").alias("clause_index"), number.alias("clause_no"), part(lines, at, k).alias("own"))

    whole = F.array(F.struct(F.lit(0).cast("long").alias("clause_index"), F.lit(None).cast("string").alias("clause_no"), lines.alias("own")))
    pieces = F.when(splits, F.transform(F.sequence(F.lit(0), F.size(at)), one)).otherwise(whole)
    found = marked.select(*keys, F.explode(pieces).alias("p")).filter(F.size("p.own") > 0)
    return found.select(*keys, "p.clause_index", "p.clause_no", F.array_join("p.own", "\n").alias("clause"))


def legal_pieces(articles: DataFrame, keys: list[str], number: Column, label: str = LABEL_START) -> DataFrame:
    """Articles in pieces: keys, ``kind`` (article, clause, subclause), ``clause_no, subclause_no, heading_path, piece``.

    ``articles`` as ``segments`` gives them, ``number`` the number of each.
    Clauses must go on from it; a clause with lines that begin with a label is
    cut at these, each piece under the clause's first line; every piece but a
    whole article stands under the article's heading.  Clauses below 10 and
    labelled parts below 8 characters are dropped.
    """
    held = articles.withColumn("__no", number)
    cut = clauses(held, [*keys, "chapter", "heading"], extends=F.col("__no"), first=1)
    # what stands before the first clause is the heading, which every clause carries
    with_clauses = F.max(F.col("clause_no").isNotNull().cast("int")).over(Window.partitionBy(*keys)) == 1
    kept = cut.withColumn("__has", with_clauses).filter(F.col("clause_no").isNotNull() | ~F.col("__has"))
    kept = kept.filter(F.col("clause_no").isNull() | (F.length(F.trim("clause")) >= 10))
    lines = F.split(F.trim("clause"), "\n", -1)
    marked = kept.withColumn("__lines", lines).withColumn("__at", F.when(F.col("clause_no").isNotNull(), places(F.col("__lines"), lambda x: x.rlike(label), 1)).otherwise(F.array().cast("array<int>")))

    def one(k: Column) -> Column:
        own = F.trim(F.array_join(part(F.col("__lines"), F.col("__at"), k), "\n"))
        name = F.lower(F.regexp_extract(own, label, 1))
        return F.struct(F.concat_ws(".", "clause_no", name).alias("subclause_no"), own.alias("own"))

    labelled = F.filter(F.transform(F.sequence(F.lit(1), F.size("__at")), one), lambda x: F.length(x["own"]) >= 8)
    single = F.array(F.struct(F.lit(None).cast("string").alias("subclause_no"), F.trim("clause").alias("own")))
    rows = marked.select(*keys, "chapter", "heading", "clause_no", F.get("__lines", F.lit(0)).alias("__lead"), F.explode(F.when(F.size("__at") > 0, labelled).otherwise(single)).alias("p"))
    sub = F.col("p.subclause_no")
    return rows.select(
        *keys,
        F.when(sub.isNotNull(), "subclause").when(F.col("clause_no").isNotNull(), "clause").otherwise("article").alias("kind"),
        "clause_no", sub.alias("subclause_no"),
        F.concat_ws(" > ", "chapter", "heading", "clause_no", sub).alias("heading_path"),
        F.concat_ws("\n", F.when(F.col("clause_no").isNotNull(), F.col("heading")), F.when(sub.isNotNull(), F.col("__lead")), "p.own").alias("piece"),
    )


def fold_pack(parts: Column, most: int, overlap: int, glue: str, least: int = 0) -> Column:
    """Greedy packing of an array of strings: a pack closes before it would exceed ``most`` and the next starts with its last ``overlap`` characters."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, part: Column) -> Column:
        joined = F.when(state["open"] == "", part).otherwise(F.concat(state["open"], F.lit(glue), part))
        full = (F.length(joined) > most) & (state["open"] != "")
        tail = F.when(F.length(state["open"]) <= overlap, state["open"]).otherwise(F.substring(state["open"], F.lit(-overlap), F.lit(overlap)))
        closed = F.when(F.length(state["open"]) >= least, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.struct(
            F.when(full, closed).otherwise(state["done"]).alias("done"),
            F.when(full, F.concat(tail, F.lit(glue), part)).otherwise(joined).alias("open"),
        )

    def finish(state: Column) -> Column:
        keep = (F.trim(state["open"]) != "") & (F.length(state["open"]) >= least)
        return F.when(keep, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])

    return F.aggregate(parts, empty, add, finish)


def pack_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = r"\n\n+", max_tokens: int = 600, overlap_tokens: int = 64, min_tokens: int = 50) -> DataFrame:
    """``doc_id, chunk_index, chunk, token_count``: paragraphs packed by estimated tokens (4 characters each)."""
    paragraphs = F.filter(F.split(text, mark, -1), lambda p: F.trim(p) != "")
    packs = fold_pack(paragraphs, 4 * max_tokens, 4 * overlap_tokens, "\n\n", 4 * (min_tokens - 1) + 1)
    rows = docs.select(F.col(doc_id), F.posexplode(packs).alias("chunk_index", "chunk"))
    return rows.withColumn("token_count", F.ceil(F.length("chunk") / 4).cast("int"))


def pack_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, chunk_index, chunk``: sentences packed to ``most`` characters; a longer sentence is cut into strides first."""
    sentences = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), r"\n+", -1)
    stride = most - overlap
    cut = F.flatten(F.transform(F.filter(sentences, lambda s: F.trim(s) != ""), lambda s: F.transform(
        F.sequence(F.lit(0), F.greatest(F.length(s) - overlap - 1, F.lit(0)), F.lit(stride)),
        lambda i: F.trim(F.substring(s, i + 1, F.lit(most))),
    )))
    return docs.select(F.col(doc_id), F.posexplode(fold_pack(cut, most, overlap, "\n")).alias("chunk_index", "chunk"))


def merge_small(pieces: DataFrame, keys: list[str], position: str, text: str, small: int = MERGE_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """Pieces below ``small`` join the one before them in their group while the sum stays below ``most``: keys, ``piece_index, piece``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: x[text])

    def add(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.length(piece) < small) & (F.length(last) + F.length(piece) < most)
        merged = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), piece)))
        return F.when(joins, merged).otherwise(F.concat(done, F.array(piece)))

    folded = pieces.groupBy(*keys).agg(ordered.alias("__all"))
    merged = F.aggregate("__all", F.array().cast("array<string>"), add)
    return folded.select(*keys, F.posexplode(merged).alias("piece_index", "piece"))


def piece_key(text: Column, *parts: Column) -> Column:
    """Hash by which repeated pieces are told: the parts and the first 200 characters in normal form."""
    return F.sha2(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts), F.substring(F.lower(collapse_space(text)), 1, 200)), 256)


def contextual(chunk: Column, **headers: Column) -> Column:
    """Chunk under its non-null header lines ``Name: value``."""
    named = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k.capitalize()}: "), F.substring(collapse_space(v), 1, 180))) for k, v in headers.items()]
    head = F.concat_ws("\n", *named)
    return F.when(head == "", F.trim(chunk)).otherwise(F.concat(head, F.lit("\n\n"), F.trim(chunk)))

"""Retrieval for tables of questions: exact vector search, full text, trigrams, phrases, and merging of hit lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rows import top_k

#: Questions that one pass over the corpus answers; their vectors are what is broadcast.
QUESTION_BLOCK = 4096
#: Pairs of a row's term and a question that a task expands at a time; rows that it scores together.
EXPANDED, SLICE = 1_000_000, 1_000
WORD = r"[\p{L}\p{N}]+"
#: Article numbers: figures parted by full stops.
NUMBER = r"[0-9]+(?:\.[0-9]+)+"


#: Bytes of the questions of a block, as they are sent to tasks.
BLOCK_BYTES = 32 << 20


def question_blocks(questions: DataFrame, columns: list[str], block: int = QUESTION_BLOCK) -> Iterator[list]:
    """Rows of the question table, at most about ``block`` and ``BLOCK_BYTES`` at a time: an id hash deals them.  Rows without an id ask nothing."""
    asked = questions.filter(F.col(columns[0]).isNotNull()).select(*columns)
    total, size = asked.agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct(*columns))).cast("long"))).first()
    n = max(-(-total // block), -(-(size or 0) // BLOCK_BYTES))
    for k in range(n):
        yield asked.filter(F.pmod(F.xxhash64(columns[0]), F.lit(n)) == k).collect()


class Nearest:
    """The k best rows of each question seen by a task; rows of one id count each."""

    def __init__(self, n: int, k: int):
        # places not taken yet score -2, scores that are no number -1
        self.score, self.id = np.full((n, k), -2.0), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in a matrix of the questions from ``at`` on and rows with ``ids``."""
        top, top_id = self.score[at : at + len(scores)], self.id[at : at + len(scores)]
        n, k = top.shape
        # scores come unrounded, so the bounds are lower by more than rounding adds
        least = top[:, -1]
        if scores.shape[1] > k and (least < -1).any():
            least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
        question, row = np.nonzero(scores >= (least - 1e-6)[:, None])
        score, own = np.round(scores[question, row], 6), ids[row]
        better = (score > top[question, -1]) | ((score == top[question, -1]) & (own < top_id[question, -1]))
        question, score, own = question[better], score[better], own[better]
        some, place = np.unique(question, return_inverse=True)
        if not len(some):
            return
        asker = np.concatenate((np.repeat(np.arange(len(some)), k), place))
        score, own = np.concatenate((top[some].ravel(), score)), np.concatenate((top_id[some].ravel(), own))
        order = np.lexsort((own, -score, asker))
        asker = asker[order]
        order = order[np.arange(len(order)) - np.searchsorted(asker, asker, "left") < k]
        top[some], top_id[some] = score[order].reshape(-1, k), own[order].reshape(-1, k)


def vector_top_k(questions: DataFrame, items: DataFrame, k: int, dims: int | None = None) -> DataFrame:
    """``query_id, id, score, rank``: the k items of highest cosine (clamped to 0..1, six digits) for each question.

    ``questions(query_id, vector)`` go in blocks; each task multiplies its
    items with a block, ``SLICE`` items and ``EXPANDED`` pairs at a time, and
    passes on its best k for each question, so the shuffle carries k rows for
    each task and question and no vectors.
    """
    out = None
    for rows in question_blocks(questions, ["query_id", "vector"]):
        ids = np.array([r["query_id"] for r in rows], np.int64)
        asked = np.array([r["vector"] for r in rows], np.float64)[:, :dims]
        asked /= np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
        shared = items.sparkSession.sparkContext.broadcast((ids, asked))

        def best(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            found = Nearest(len(ids), k)
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    part = batch.slice(start, SLICE)
                    matrix = np.array(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(part.num_rows, -1)[:, :dims]
                    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
                    step = max(1, EXPANDED // part.num_rows)
                    for at in range(0, len(ids), step):
                        scores = asked[at : at + step] @ matrix.T
                        np.clip(scores, 0, 1, out=scores)
                        np.copyto(scores, -1, where=np.isnan(scores))
                        found.add(at, scores, part.column(0).to_numpy())
            question, place = np.nonzero(found.score > -2)
            if len(question):
                score = found.score[question, place]
                yield pa.RecordBatch.from_arrays([pa.array(ids[question]), pa.array(found.id[question, place]), pa.array(np.where(score < 0, np.nan, score))], names=["query_id", "id", "score"])

        part = items.select("id", "vector").mapInArrow(best, "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return questions.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    return top_k(out, ["query_id"], [F.desc("score"), F.col("id")], k)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where they come in fewer partitions than there are (small files of one row group); tables of many partitions stay as they are."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


#: Rows of a batch, questions of a block and scores of the hits.
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


class TermIndex:
    """Terms of a block of questions: which questions hold each of them, and which terms each question holds."""

    def __init__(self, rows: list):
        self.ids = np.array([r["query_id"] for r in rows], np.int64)
        self.sizes = np.array([len(r["terms"] or ()) for r in rows], np.int64)
        known: dict[str, int] = {}
        #: Terms of the questions, one question after another.
        self.held = np.array([known.setdefault(term, len(known)) for r in rows for term in r["terms"] or ()], np.int64)
        self.terms = list(known)
        self.vocabulary = pa.array(self.terms, pa.string())
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._post(np.ones(len(self.held), bool))

    def _post(self, kept: np.ndarray) -> None:
        """Lists of the questions that hold each term, of the places ``kept``."""
        asker = np.repeat(np.arange(len(self.ids)), self.sizes)[kept]
        order = np.argsort(self.held[kept], kind="stable")
        self.holders = asker[order]
        self.many = np.bincount(self.held[kept], minlength=len(self.terms))
        self.first = np.cumsum(self.many) - self.many

    def rarest(self, lengths: np.ndarray, frequency: np.ndarray) -> TermIndex:
        """The same index with the lists of each question's rarest terms alone, ``lengths`` of them."""
        asker = np.repeat(np.arange(len(self.ids)), self.sizes)
        order = np.lexsort((self.held, frequency[self.held], asker))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - self.starts[asker[order]]
        out = copy(self)
        out._post(place < np.repeat(lengths, self.sizes))
        return out

    def occurrences(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times) of the known terms in each list."""
        found = pc.index_in(lists.flatten(), self.vocabulary)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        known = found.is_valid().to_numpy(zero_copy_only=False)
        keys, times = np.unique(row[known] * max(len(self.terms), 1) + found.drop_null().to_numpy(), return_counts=True)
        return keys // max(len(self.terms), 1), keys % max(len(self.terms), 1), times

    def summed(self, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Matrix of rows and questions: the weights of the terms that both hold, ``EXPANDED`` pairs at a time."""
        out = np.zeros(n * len(self.ids))
        many = self.many[term]
        ends = np.cumsum(many)
        at = 0
        while at < len(term):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED, "right")))
            own = many[at:to]
            holder = self.holders[np.repeat(self.first[term[at:to]] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
            np.add.at(out, np.repeat(row[at:to], own) * len(self.ids) + holder, np.repeat(weight[at:to], own))
            at = to
        return out.reshape(n, len(self.ids))

    def shared(self, row: np.ndarray, term: np.ndarray, rows: np.ndarray, questions: np.ndarray) -> np.ndarray:
        """How many terms the row and the question of each pair share; ``row`` and ``rows`` ascend."""
        out, mark = np.zeros(len(rows), np.int64), np.zeros(len(self.terms), bool)
        begin, end = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
        for at in np.flatnonzero(np.diff(rows, prepend=-1)):
            to = np.searchsorted(rows, rows[at], "right")
            mine = term[begin[at] : end[at]]
            mark[mine] = True
            sizes, starts = self.sizes[questions[at:to]], self.starts[questions[at:to]]
            ends = np.cumsum(sizes)
            hit = np.concatenate(([0], np.cumsum(mark[self.held[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]], dtype=np.int64)))
            out[at:to] = hit[ends] - hit[ends - sizes]
            mark[mine] = False
        return out


class Best:
    """The k best ids of each question seen by a task, an id with its highest score."""

    def __init__(self, questions: np.ndarray, k: int):
        self.questions, self.k = questions, k
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def add(self, question: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        question, ids, score = (np.concatenate(pair) for pair in zip(self.held, (question, ids, score), strict=True))
        order = np.lexsort((-score, ids, question))
        question, ids, score = question[order], ids[order], score[order]
        first = np.ones(len(ids), bool)
        first[1:] = (question[1:] != question[:-1]) | (ids[1:] != ids[:-1])
        question, ids, score = question[first], ids[first], score[first]
        order = np.lexsort((ids, -score, question))
        question, ids, score = question[order], ids[order], score[order]
        place = np.arange(len(ids)) - np.searchsorted(question, question, "left")
        self.held = [x[place < self.k] for x in (question, ids, score)]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.questions[self.held[0]]), pa.array(self.held[1]), pa.array(self.held[2])], names=["query_id", "id", "score"])


def score_blocks(questions: DataFrame, docs: DataFrame, k: int, scored: Callable[[TermIndex, tuple, pa.RecordBatch], Pairs], extra: Callable[[TermIndex], object] = lambda index: None, columns: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, id, score, rank``: the k best documents of each question.

    ``questions(query_id, terms, *columns)`` go in blocks, as index of their
    terms, to all ``docs(id, terms, ...)``.  ``scored`` gives, for an index,
    what ``extra`` made of it, and some documents, the hits among these: row,
    question of the block and score.  Each task passes on its
    best k for each question: nothing else is shuffled, whatever terms are
    common.
    """
    out = None
    for rows in question_blocks(questions, ["query_id", "terms", *columns]):
        index = TermIndex(rows)
        shared = docs.sparkSession.sparkContext.broadcast((index, [tuple(r[c] for c in columns) for r in rows], extra(index)))

        def best(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, asked, more = shared.value
            found = Best(index.ids, k)
            step = max(1, min(SLICE, EXPANDED // max(len(index.ids), 1)))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    row, question, scores = scored(index, (asked, more), part)
                    found.add(question, part.column("id").to_numpy()[row], scores)
            yield found.batch()

        part = docs.mapInArrow(best, "query_id long, id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return questions.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    # an id that several tasks hold parts of counts once, with its best part
    single = out.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top_k(single, ["query_id"], [F.desc("score"), F.col("id")], k)


def _terms(questions: DataFrame, least_chars: int = 0) -> DataFrame:
    terms = F.array_distinct(words(F.col("text")))
    return questions.select("query_id", F.filter(terms, lambda t: F.length(t) > least_chars).alias("terms"))


def full_text(questions: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, title_weight: float = 1.0, body_weight: float = 0.4) -> DataFrame:
    """``query_id, id, score, rank``: documents that hold all terms of a question, by a closed form of BM25F.

    The title is the first line.  A term's weighted count w adds
    ``ln(1 + (N - n + 0.5) / (n + 0.5)) * 2.2 w / (w + 1.2)``; the sum over 10,
    at most 1, is the score.  One pass counts the documents n of each asked
    term.  A second one looks at documents that hold a question's rarest term,
    and scores those that hold all.
    """
    asked = _terms(questions)
    both = words(F.col(text))
    title = words(F.regexp_extract(text, r"^([^\n]*)", 1))
    rows = spread(docs.select(doc_id, text)).select(F.col(doc_id).cast("long").alias("id"), both.alias("terms"), title.alias("title"))
    total = docs.count()

    def rarity(index: TermIndex) -> tuple[np.ndarray, TermIndex]:
        vocabulary = docs.sparkSession.sparkContext.broadcast(index.vocabulary)

        def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(vocabulary.value), np.int64)
            for batch in batches:
                lists = batch.column(0)
                found = pc.index_in(lists.flatten(), vocabulary.value)
                row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                known = found.is_valid().to_numpy(zero_copy_only=False)
                pairs = np.unique(row[known] * max(len(n), 1) + found.drop_null().to_numpy())
                n += np.bincount(pairs % max(len(n), 1), minlength=len(n))[: len(n)]
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["term", "n"])

        counts = rows.select("terms").mapInArrow(held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(len(index.terms))
        n[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
        return np.log(1 + (total - n + 0.5) / (n + 0.5)), index.rarest(np.ones(len(index.ids), np.int64), n)

    def scored(index: TermIndex, asked: tuple, batch: pa.RecordBatch) -> Pairs:
        idf, rarest = asked[1]
        row, term, times = index.occurrences(batch.column("terms"))
        near_row, near_question = np.nonzero(rarest.summed(batch.num_rows, row, term, np.ones(len(row))))
        hit = index.shared(row, term, near_row, near_question) == index.sizes[near_question]
        near_row, near_question = near_row[hit], near_question[hit]
        some = np.isin(row, near_row)
        row, term, times = row[some], term[some], times[some]
        head_row, head_term, head_times = index.occurrences(batch.column("title"))
        width, own = max(len(index.terms), 1), np.isin(head_row, near_row)
        in_title = np.zeros(len(row), np.int64)
        in_title[np.searchsorted(row * width + term, head_row[own] * width + head_term[own])] = head_times[own]
        weight = in_title * title_weight + (times - in_title) * body_weight
        part = idf[term] * 2.2 * weight / (weight + 1.2)
        # all terms of the question are there, so each is found in the row's
        sizes = index.sizes[near_question]
        ends = np.cumsum(sizes)
        held = index.held[np.repeat(index.starts[near_question] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        at = np.searchsorted(row * width + term, np.repeat(near_row, sizes) * width + held)
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), part[at], len(sizes))
        return near_row, near_question, np.round(np.minimum(sums / 10, 1), 6)

    return score_blocks(asked, rows, k, scored, rarity)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the padded words of a text."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_search(questions: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, threshold: float = 0.3) -> DataFrame:
    """``query_id, id, score, rank``: the k ids of highest trigram similarity (shared over all distinct trigrams), the best row of an id counting.

    A row is a hit above ``threshold``, or if it contains the question, in any
    case.  Rows meet a question by its rarest trigrams; those that cannot share
    enough, by the numbers of trigrams of both, are not looked at further.
    """
    asked = questions.select("query_id", trigrams(F.col("text")).alias("terms"), F.lower("text").alias("low"))
    rows = spread(docs.select(doc_id, text)).select(F.col(doc_id).cast("long").alias("id"), trigrams(F.col(text)).alias("terms"), F.lower(text).alias("low"))
    #: Trigrams of a question that a text which contains it may lack: its outer words may go on there.
    outer = 6

    def rare(index: TermIndex) -> tuple[TermIndex, np.ndarray]:
        """Lists of the trigrams of which a hit holds one at least, and how many each question has besides."""
        n = index.sizes
        # a hit shares more than threshold * n, or all but ``outer``
        lengths = np.minimum(n, np.maximum(n - np.ceil(threshold * n).astype(np.int64) + 1, outer + 1))
        return index.rarest(lengths, index.many), n - lengths

    def scored(index: TermIndex, asked: tuple, batch: pa.RecordBatch) -> Pairs:
        rarest, besides = asked[1]
        row, term, _ = index.occurrences(batch.column("terms"))
        own = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False)
        first = rarest.summed(batch.num_rows, row, term, np.ones(len(row)))
        # what is shared at most: the rare ones found and all others; s / (m + n - s) > t asks for s > t (m + n) / (1 + t)
        most = first + besides
        near = (first > 0) & ((most * (1 + threshold) >= threshold * (own[:, None] + index.sizes) - 1e-6) | (most >= index.sizes - outer))
        near_row, near_question = np.nonzero(near)
        shared = index.shared(row, term, near_row, near_question)
        sizes = index.sizes[near_question]
        score = np.round(shared / np.maximum(own[near_row] + sizes - shared, 1), 6)
        hit = score > threshold
        texts = batch.column("low")
        for i in np.flatnonzero(~hit & (shared >= sizes - outer)).tolist():
            low = asked[0][near_question[i]][0]
            hit[i] = bool(low) and low in (texts[int(near_row[i])].as_py() or "")
        return near_row[hit], near_question[hit], score[hit]

    return score_blocks(asked, rows, k, scored, rare, columns=("low",))


def phrase_search(questions: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """``query_id, id, score, rank``: documents that hold the words of the question side by side, by number of places (without overlap).

    Candidates hold the question's first two words side by side (its only word,
    if it has one); the whole phrase is then looked for in them.
    """
    spaced = lambda t: F.concat(F.lit(" "), F.array_join(words(t), "  "), F.lit(" "))
    own = words(F.col("text"))
    asked = questions.select("query_id", F.array_join(F.slice(own, 1, 2), " ").alias("start"), spaced(F.col("text")).alias("phrase")).filter("start <> ''")
    held = words(F.col(text))
    pairs = F.zip_with(held, F.slice(held, 2, F.greatest(F.size(held), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    docs = spread(docs.select(doc_id, text))
    starts = docs.select(F.col(doc_id).alias("id"), F.explode(F.array_distinct(F.concat(held, F.array_compact(pairs)))).alias("start"))
    met = starts.join(asked, "start").select("query_id", "id", "phrase")
    found = met.join(docs.select(F.col(doc_id).alias("id"), spaced(F.col(text)).alias("whole")), "id")
    places = (F.length("whole") - F.length(F.replace("whole", "phrase", F.lit("")))) / F.length("phrase")
    scored = found.select("query_id", "id", places.cast("long").alias("score")).filter("score > 0")
    return top_k(scored, ["query_id"], [F.desc("score"), F.col("id")], k)


def term_frequency_search(questions: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """``query_id, id, score, rank``: sum of count times length over the distinct terms longer than two characters, over 100, at most 1."""
    rows = spread(docs.select(doc_id, text)).select(F.col(doc_id).cast("long").alias("id"), words(F.col(text)).alias("terms"))

    def scored(index: TermIndex, asked: tuple, batch: pa.RecordBatch) -> Pairs:
        row, term, times = index.occurrences(batch.column("terms"))
        sums = index.summed(batch.num_rows, row, term, (times * asked[1][term]).astype(float))
        near = np.nonzero(sums)
        return *near, np.round(np.minimum(sums[near] / 100, 1), 6)

    return score_blocks(_terms(questions, least_chars=2), rows, k, scored, lambda index: np.array([len(t) for t in index.terms], np.int64))


def article_lookup(numbers: DataFrame, texts: DataFrame, article: Column, law: Column, text: Column, id: Column, first: int = 10, most: int = 5) -> DataFrame:
    """``number, id, score, rank``: texts by article number: 1 where it is the text's article, 0.6 where the text contains it.

    ``first`` rows of each number, of these one of each law, article and first
    60 characters, and of these ``most``.
    """
    held = texts.select(id.alias("id"), law.alias("law"), article.alias("article"), F.substring(text, 1, 60).alias("head"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))).alias("number"))
    met = held.join(numbers.select("number").distinct(), "number").withColumn("score", F.when(F.col("article") == F.col("number"), 1.0).otherwise(0.6))
    return _first_articles(met, first, most)


def _first_articles(met: DataFrame, first: int, most: int) -> DataFrame:
    order = [F.desc("score"), F.col("id")]
    single = top_k(top_k(met, ["number"], order, first, "place"), ["number", "law", "article", "head"], order, 1, "copy")
    return top_k(single, ["number"], order, most).select("number", "id", "score", "rank")


def article_search(numbers: DataFrame, texts: DataFrame, article: Column, law: Column, text: Column, id: Column, first: int = 10, most: int = 5) -> DataFrame:
    """``number, id, score, rank``: as ``article_lookup``, and 0.1 for texts in which all figures of the number stand as words.

    A number is contained wherever its characters stand, also within a longer
    one.  Numbers meet texts by the texts' own numbers, their parts and their
    words of figures; texts are not shuffled.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)*"), F.lit(0))
    # every run of figures and stops within a text's numbers that could be asked for: from any character to any other
    lengths = sorted(r[0] for r in numbers.select(F.length("number")).distinct().collect())
    cuts = lambda n: F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda k: F.when(F.length(n) >= k, F.transform(F.sequence(F.lit(1), F.length(n) - k + 1), lambda i: F.substring(n, i, k))).otherwise(F.array().cast("array<string>"))))
    words_of = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[0-9]+\b"), F.lit(0)))
    about = texts.select(id.alias("id"), law.alias("law"), article.alias("article"), F.substring(text, 1, 60).alias("head"), F.array_distinct(F.flatten(F.transform(tokens, cuts))).alias("runs"), words_of.alias("figures"))
    asked = numbers.select("number").distinct()
    same = about.select("id", F.col("article").alias("number"), F.lit(1.0).alias("score")).join(asked, "number", "left_semi")
    within = about.select("id", F.explode("runs").alias("number"), F.lit(0.6).alias("score")).join(asked, "number", "left_semi")
    parts = asked.select("number", F.explode(F.array_distinct(F.split("number", r"\."))).alias("figure"))
    needed = parts.groupBy("number").agg(F.count(F.lit(1)).alias("needed"))
    met = about.select("id", F.explode("figures").alias("figure")).join(parts, "figure").groupBy("id", "number").agg(F.count(F.lit(1)).alias("met")).join(needed, "number").filter("met = needed")
    found = same.unionByName(within).unionByName(met.select("id", "number", F.lit(0.1).alias("score"))).groupBy("id", "number").agg(F.max("score").alias("score"))
    return _first_articles(found.join(about.drop("runs", "figures"), "id"), first, most)


def focused_clauses(hits: DataFrame, pieces: DataFrame, terms: DataFrame, documents: int = 6, most: int = 24, within: str = "doc_id", text: str = "text", order: tuple[str, ...] = ("chunk_index",)) -> DataFrame:
    """``query_id, <within>, <order>, score``: pieces of the ``documents`` best hit by a question that hold some of its ``terms``, up to ``most``, by 0.72 and 0.08 a term, at most 0.97.

    Only pieces of documents that are hit are looked at.
    """
    near = hits.filter(F.col("rank") <= documents).select("query_id", F.col("id").alias(within)).distinct()
    rows = pieces.join(near.select(within).distinct(), within, "left_semi").join(near, within).join(terms.select("query_id", "terms"), "query_id")
    low = F.lower(text)
    n = F.size(F.filter("terms", lambda t: F.contains(low, t)))
    scored = rows.select("query_id", within, *order, n.alias("n")).filter("n > 0")
    first = top_k(scored, ["query_id"], [F.desc("n"), F.col(within), *map(F.col, order)], most, "place")
    return first.select("query_id", within, *order, F.round(F.least(0.72 + 0.08 * F.col("n"), F.lit(0.97)), 6).alias("score"))


def fallback(primary: DataFrame, secondary: DataFrame, fewest: int = 1) -> DataFrame:
    """Hits of ``primary`` for questions with at least ``fewest``; for the others the larger of the two lists."""
    n = lambda hits, name: hits.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    sizes = n(primary, "p").join(n(secondary, "s"), "query_id", "full").na.fill(0, ["p", "s"])
    choice = sizes.select("query_id", ((F.col("p") >= fewest) | (F.col("p") >= F.col("s"))).alias("first"))
    mine = primary.join(choice.filter("first"), "query_id", "left_semi")
    return mine.unionByName(secondary.join(choice.filter("not first"), "query_id", "left_semi"))


def rules_search(docs: DataFrame, rules: list[tuple[str, str, float]], text: str, doc_id: str, k: int) -> DataFrame:
    """``rule, id, score, rank``: documents that contain a rule's marker, best score per document and rule, shorter texts first.  ``rules``: (rule, marker, score)."""
    scores = {}
    for rule, marker, score in rules:
        scores.setdefault(rule, []).append(F.when(F.contains(F.lower(F.col(text)), F.lit(marker.lower())), F.lit(score)))
    columns = F.array(*(F.struct(F.lit(rule).alias("rule"), F.greatest(*s, F.lit(None)).alias("score")) for rule, s in scores.items()))
    hits = docs.select(F.col(doc_id).alias("id"), F.length(text).alias("chars"), F.explode(columns).alias("r")).select("id", "chars", "r.rule", "r.score")
    found = top_k(hits.filter("score is not null"), ["rule"], [F.desc("score"), F.col("chars"), F.col("id")], k)
    return found.select("rule", "id", "score", "rank")


def coverage(hits: DataFrame, preferred: Column, within: int, fewest: int, floor: float) -> DataFrame:
    """``query_id, preferred, strong``: whether enough preferred hits stand within the first ranks and the best score reaches the floor."""
    counted = hits.groupBy("query_id").agg(F.count_if(preferred & (F.col("rank") <= within)).alias("preferred"), F.max("score").alias("top"))
    return counted.select("query_id", "preferred", ((F.col("preferred") >= fewest) & (F.col("top") >= floor)).alias("strong"))

"""Numbered section trees of statutes, and chunk rows from them.

One fold over a document's lines keeps the open chapter, article, clause and
labelled part, and gives a node for each; a node's parent, path and place in the
text are known when it opens.  Chunks are leaves of the tree: an article is cut
at its clauses if it has some or is long, a clause at its labels.  All of a
document stays in its row, and the fold is linear in its text; nothing is
shuffled, and no chunk is looked up in the texts again.

Wording (chapter and article headings, references, stop words) is a parameter.
A null or empty text has no nodes; a text without articles is cut at its
chapters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import stable_uuid
from lodestone.operators.chunk import CLAUSE_START, LABEL_START, MAX_CHARS, MERGE_CHARS, OVERLAP_CHARS

#: Values that must match: references and amendment lines of a chunk, keywords, characters of a heading in a header, clauses from which an article is cut.
MOST_REFERENCES, MOST_AMENDMENTS, MOST_KEYWORDS, HEADING_CHARS, FEWEST_CLAUSES = 12, 8, 12, 180, 3
#: Values that must match: shortest preamble, article, clause, labelled part and chunk.
LEAST = {"preamble": MERGE_CHARS, "article": 20, "clause": 10, "subclause": 8, "chunk": 20}


@dataclass(frozen=True)
class Grammar:
    """How a text says what it is made of.  ``article`` has the number and the title as groups."""

    article: str
    chapter: str
    clause: str = CLAUSE_START
    label: str = LABEL_START.replace(r"\p{L}", r"[^\W\d_]")
    reference: str = r"(?i)\barticle\s+[0-9]+(?:\.[0-9]+)*"
    amendment: str = r"(?i)\b(?:amended|repealed|replaced|added)\b"
    suffix: str = r"(?:ing|s)$"
    stop: tuple[str, ...] = ()
    #: Names of the header lines: law, chapter, article, part, clause.
    header: tuple[str, str, str, str, str] = ("Law", "Chapter", "Article", "Part", "Clause")


@dataclass
class Node:
    """A part of a document, from one place in the text to another; ``path`` names what it stands in and itself."""

    kind: str
    no: str
    title: str
    parent: int
    path: tuple[str, ...]
    chapter: str
    start: int
    end: int = 0
    first_line: int = 0


def section_tree(text: str, grammar: Grammar) -> list[Node]:
    """Chapters, articles, clauses and labelled parts in order; what stands before the first article of a text with articles is its preamble.

    A clause's number goes on from its article's.  A chapter closes what is
    open above articles only: its line may stand at the end of an article.
    """
    chapter, article, clause, label = (re.compile(p) for p in (grammar.chapter, grammar.article, grammar.clause, grammar.label))
    nodes: list[Node] = []
    open_: dict[str, int] = {}
    name, at = "", 0

    def close(*kinds: str) -> None:
        for kind in kinds:
            if kind in open_:
                nodes[open_.pop(kind)].end = at

    def begin(kind: str, no: str, title: str, above: str | None) -> None:
        parent = open_[above] if above else -1
        own = title if kind == "article" else no.rsplit(".", 1)[-1] if kind == "subclause" else no
        path = (*(nodes[parent].path if above else (name,) * bool(name)), own)
        open_[kind] = len(nodes)
        nodes.append(Node(kind, no, title, parent, path, name, at, first_line=number))

    for number, line in enumerate(text.split("\n")):
        said = line.strip()
        if found := article.match(said):
            close("subclause", "clause", "article", "preamble")
            begin("article", found[1], said, None)
        elif chapter.match(said):
            name = said
            nodes.append(Node("chapter", "", said, -1, (said,), said, at, at + len(line), number))
        elif "article" in open_ and (found := clause.match(said + " ")) and found[1].startswith(f"{nodes[open_['article']].no}."):
            close("subclause", "clause")
            begin("clause", found[1], said, "article")
        elif "clause" in open_ and (found := label.match(said + " ")):
            close("subclause")
            begin("subclause", f"{nodes[open_['clause']].no}.{found[1].lower()}", said, "clause")
        elif number == 0:
            begin("preamble", "preamble", "", None)
        at += len(line) + 1
    at = len(text) + 1
    close("subclause", "clause", "article", "preamble")
    for n in nodes:
        n.end = min(n.end if n.kind == "chapter" else n.end - 1, len(text))
    return nodes


@dataclass
class Piece:
    kind: str
    text: str
    start: int
    end: int
    chapter: str = ""
    article_no: str = ""
    article_title: str = ""
    clause_no: str = ""
    subclause_no: str = ""
    path: str = ""
    references: list[str] = field(default_factory=list)
    amendments: list[str] = field(default_factory=list)


def distinct(values: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(values))


def packed(text: str, start: int, most: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """``part, start, end``: sentences packed up to ``most`` characters, each part beginning with the last ``overlap`` of the one before; a longer sentence is cut into strides.  One scan from left to right."""
    spans: list[tuple[int, int]] = []
    at = 0
    for m in re.finditer(r"(?<=[.!?])\s+|\Z", text):
        begin, end = at, m.start()
        while end - begin > most:
            spans.append((begin, begin + most))
            begin += most - overlap
        if begin < end:
            spans.append((begin, end))
        at = m.end()
    first, last = None, 0
    for begin, end in spans:
        if first is not None and end - first > most:
            yield text[first:last].strip(), start + first, start + last
            first = min(begin, max(last - overlap, 0)) if end - max(last - overlap, 0) <= most else begin
        first, last = begin if first is None else first, end
    if first is not None:
        yield text[first:last].strip(), start + first, start + last


def leaves(text: str, nodes: list[Node], grammar: Grammar, most: int) -> Iterator[Piece]:
    """The pieces that a document is cut into, before long ones are packed."""
    reference, amendment = re.compile(grammar.reference), re.compile(grammar.amendment)
    title = re.compile(grammar.article)
    below: dict[int, list[int]] = {}
    for i, n in enumerate(nodes):
        below.setdefault(n.parent, []).append(i)

    def piece(n: Node, kind: str, above: tuple[str, ...] = (), **more: str) -> Piece:
        raw = text[n.start : n.end]
        own, start = raw.strip(), n.start + len(raw) - len(raw.lstrip())
        references = distinct(re.sub(r"\s+", " ", m[0]) for m in reference.finditer(own))[:MOST_REFERENCES]
        amendments = [x.strip() for x in own.split("\n") if amendment.search(x)][:MOST_AMENDMENTS]
        return Piece(kind, "\n".join((*above, own)), start, start + len(own), n.chapter, path=" > ".join(n.path), references=references, amendments=amendments, **more)

    for i, n in enumerate(nodes):
        size = len(text[n.start : n.end].strip())
        if n.kind == "preamble" and size >= LEAST["preamble"] and any(x.kind == "article" for x in nodes):
            yield piece(n, "section")
        if n.kind != "article" or size < LEAST["article"]:
            continue
        about = {"article_no": n.no, "article_title": (title.match(n.title)[2] or "").strip()}
        cut = []
        clauses = below.get(i, [])
        for c in clauses if len(clauses) >= FEWEST_CLAUSES or size > most else []:
            clause = nodes[c]
            if len(text[clause.start : clause.end].strip()) < LEAST["clause"]:
                continue
            labelled = [nodes[x] for x in below.get(c, []) if len(text[nodes[x].start : nodes[x].end].strip()) >= LEAST["subclause"]]
            if labelled:
                cut += [piece(x, "subclause", (n.title, clause.title), clause_no=clause.no, subclause_no=x.no, **about) for x in labelled]
            else:
                cut.append(piece(clause, "clause", (n.title,), clause_no=clause.no, **about))
        yield from cut or [piece(n, "article", **about)]


def sectioned(text: str, nodes: list[Node]) -> Iterator[Piece]:
    """A text without articles, cut at its chapters."""
    starts = [n for n in nodes if n.kind == "chapter"]
    bounds = [0, *(n.start for n in starts), len(text)]
    names = ["", *(n.title for n in starts)]
    for begin, end, name in zip(bounds, bounds[1:], names, strict=False):
        raw = text[begin:end]
        if own := raw.strip():
            start = begin + len(raw) - len(raw.lstrip())
            yield Piece("section", own, start, start + len(own), name, path=name)


def pieces(text: str, grammar: Grammar, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS, small: int = MERGE_CHARS) -> list[Piece]:
    """The chunks of a document: leaves, long ones packed, small ones joined to the one before of their article, repeated ones left out."""
    nodes = section_tree(text, grammar)
    found: list[Piece] = []
    whole = leaves(text, nodes, grammar, most) if any(n.kind == "article" for n in nodes) else sectioned(text, nodes)
    for p in whole:
        # headings above a piece stand elsewhere in the text, so what is packed begins that much earlier
        above = len(p.text) - (p.end - p.start)
        cut = [replace(p, text=t, start=max(a, p.start), end=max(b, p.start)) for t, a, b in packed(p.text, p.start - above, most, overlap)] if len(p.text) > most else [p]
        for c in cut:
            last = found[-1] if found else None
            if last and len(c.text) < small and last.article_no == c.article_no and len(last.text) + len(c.text) < most:
                found[-1] = replace(last, text=f"{last.text}\n{c.text}".strip(), end=max(last.end, c.end), references=distinct(last.references + c.references), amendments=distinct(last.amendments + c.amendments))
            else:
                found.append(c)
    # the first 200 characters in normal form tell repeated pieces
    by_key = {(p.article_no, p.subclause_no or p.clause_no, re.sub(r"\s+", " ", p.text.lower()).strip()[:200]): p for p in reversed(found)}
    kept = {id(p) for p in by_key.values()}
    return [p for p in found if id(p) in kept]


def keywords(text: str, grammar: Grammar) -> list[str]:
    """The most frequent words of three characters or more, without suffixes and stop words; of equal counts the smaller word."""
    cut = (re.sub(grammar.suffix, "", w) for w in re.findall(r"[^\W_][\w.]{2,}", text.lower()))
    counts = Counter(w for w in cut if len(w) >= 3 and w not in grammar.stop)
    return [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:MOST_KEYWORDS]]


def in_context(p: Piece, law: str, grammar: Grammar) -> str:
    """A chunk's text under its header lines."""
    short = lambda x: x if len(x) <= HEADING_CHARS else x[:HEADING_CHARS].strip() + "..."
    names = grammar.header
    part = p.subclause_no or p.clause_no
    lines = [
        f"{names[0]}: {short(law)}" if law else "", f"{names[1]}: {short(p.chapter)}" if p.chapter else "",
        f"{names[2]}: {p.article_no} {short(p.article_title)}".strip() if p.article_no else "", f"{names[3]}: {part}" if part else "",
    ]
    head = "\n".join(x for x in lines if x)
    return f"{head}\n\n{p.text}".strip() if head else p.text


NODE = "node int, parent int, kind string, no string, path string, chapter string, first_line int, char_start int, char_end int"
CHUNK = "chunk_index int, kind string, chapter string, article_no string, article_title string, clause_no string, subclause_no string, heading_path string, text string, char_start int, char_end int, references array<string>, amendments array<string>, keywords array<string>"


def tree_table(docs: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``<doc_id>, node, parent, kind, no, path, chapter, first_line, char_start, char_end``: the sections of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                nodes = section_tree(t, grammar) if t else []
                at += [i] * len(nodes)
                rows += [(k, n.parent, n.kind, n.no, " > ".join(n.path), n.chapter, n.first_line, n.start, n.end) for k, n in enumerate(nodes)]
            yield _batch(batch.column(0), doc_id, at, rows, NODE)

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, {NODE}")


def chunk_rows(docs: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text", law: str | None = None, most: int = MAX_CHARS) -> DataFrame:
    """A row for each chunk: ``<doc_id>``, the columns of ``CHUNK`` and ``char_count, token_count, content_hash, chunk_id``.

    ``law`` is the column of the document's title.  The id is a UUID of the
    document, the index and the hash.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for i, (t, title) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                chunks = [(p, said) for p in (pieces(t, grammar, most) if t else []) if len(said := in_context(p, title or "", grammar)) >= LEAST["chunk"]]
                at += [i] * len(chunks)
                rows += [
                    (k, p.kind, p.chapter, p.article_no, p.article_title, p.clause_no, p.subclause_no, p.path, said, p.start, p.end, p.references, p.amendments, keywords(f"{title or ''}\n{said}", grammar))
                    for k, (p, said) in enumerate(chunks)
                ]
            yield _batch(batch.column(0), doc_id, at, rows, CHUNK)

    title = F.col(law) if law else F.lit(None).cast("string")
    found = docs.select(doc_id, text, title.alias("__law")).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, {CHUNK}")
    hashed = found.withColumns({"char_count": F.length("text"), "token_count": F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))), "content_hash": F.sha2("text", 256)})
    return hashed.withColumn("chunk_id", stable_uuid(F.concat_ws(":", F.col(doc_id).cast("string"), F.col("chunk_index").cast("string"), "content_hash")))


ARTICLE = "article_no string, title string, chapter string, body string, numbers array<string>, texts array<string>, references array<string>, amendments array<string>"


def article_rows(docs: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text", related: int = 5) -> DataFrame:
    """``<doc_id>`` and the columns of ``ARTICLE``: each article whole, with its title, the numbers and texts of its clauses and labelled parts, ``related`` references and its amendment lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        title, reference, amendment = re.compile(grammar.article), re.compile(grammar.reference), re.compile(grammar.amendment)
        for batch in batches:
            rows, at = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                nodes = section_tree(t, grammar) if t else []
                owner: dict[int, int] = {}
                parts: dict[int, list[Node]] = {}
                for k, n in enumerate(nodes):
                    owner[k] = k if n.kind == "article" else owner.get(n.parent, -1)
                    if n.kind in ("clause", "subclause"):
                        parts.setdefault(owner[k], []).append(n)
                for k, n in enumerate(nodes):
                    if n.kind == "article":
                        body, own = t[n.start : n.end], parts.get(k, [])
                        named = distinct(re.sub(r"\s+", " ", m[0]) for m in reference.finditer(body))[:related]
                        amended = [x.strip() for x in body.split("\n") if amendment.search(x)][:MOST_AMENDMENTS]
                        at.append(i)
                        rows.append((n.no, (title.match(n.title)[2] or "").strip(), n.chapter, body, [x.no for x in own], [t[x.start : x.end] for x in own], named, amended))
            yield _batch(batch.column(0), doc_id, at, rows, ARTICLE)

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, {ARTICLE}")


def _batch(ids: pa.Array, doc_id: str, at: list[int], rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    fields = [f.split() for f in schema.split(", ")]
    columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *columns], names=[doc_id, *(n for n, _ in fields)])

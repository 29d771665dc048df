"""Pages to lines: reading the element tree is the one step in Python, all rules after it are column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without content text, elements that end a line, and classes of advertising and navigation.
SKIPPED = frozenset(["script", "style", "noscript", "template", "form", "nav", "header", "footer", "aside", "iframe"])
BLOCKS = frozenset(["p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "th", "table", "article", "section", "main", "body", "blockquote", "pre", "title"])
AD_CLASSES = frozenset(["ad", "ads", "advert", "banner", "nav", "menu", "sidebar", "breadcrumb"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])


class _Lines(HTMLParser):
    """Text lines with the tag they stand in, inside and outside of the main container; table rows as pairs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str, bool]] = []
        self.fields: list[tuple[str, str]] = []
        self.title = self.meta_title = ""
        self.open: list[tuple[str, bool, bool]] = []  # tag, skipped, main
        self.text: list[str] = []
        self.tag = "body"
        self.head = ""

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text = []
        if not line:
            return
        skipped, main = self.open[-1][1:] if self.open else (False, False)
        if self.tag == "title":
            self.title = self.title or line
        elif self.tag == "th":
            self.head = line
        elif self.tag == "td" and self.head:
            self.fields.append((self.head, line))
            self.head = ""
        elif not skipped:
            self.lines.append((self.tag, line, main))

    def handle_starttag(self, tag, attrs):
        if tag == "meta" and dict(attrs).get("property") == "og:title":
            self.meta_title = dict(attrs).get("content") or ""
        if tag in BLOCKS or tag in SKIPPED:
            self.flush()
        if tag in VOID:
            return
        skipped, main = self.open[-1][1:] if self.open else (False, False)
        classes = set((dict(attrs).get("class") or "").lower().split())
        self.open.append((tag, skipped or tag in SKIPPED or bool(classes & AD_CLASSES), main or tag in ("article", "main")))
        if tag in BLOCKS:
            self.tag = tag

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in SKIPPED:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        if tag in BLOCKS:
            self.tag = next((t for t, _, _ in reversed(self.open) if t in BLOCKS), "body")

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.text.append(data)


_LINE = pa.struct([("tag", pa.string()), ("line", pa.string()), ("main", pa.bool_())])
_FIELD = pa.struct([("name", pa.string()), ("value", pa.string())])


def page_lines(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``page_id, title, lines array<struct<tag, line, main>>, fields array<struct<name, value>>``; a page that breaks the parser gives no lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, lines, fields = [], [], []
            for source in batch.column(1).to_pylist():
                reader = _Lines()
                try:
                    reader.feed(source or "")
                    reader.close()
                    reader.flush()
                except (AssertionError, ValueError):
                    reader = _Lines()
                heading = next((line for tag, line, _ in reader.lines if tag == "h1"), "")
                titles.append(reader.meta_title or heading or reader.title)
                lines.append([dict(zip(("tag", "line", "main"), x, strict=True)) for x in reader.lines])
                fields.append([dict(zip(("name", "value"), x, strict=True)) for x in reader.fields])
            columns = [batch.column(0), pa.array(titles, pa.string()), pa.array(lines, pa.list_(_LINE)), pa.array(fields, pa.list_(_FIELD))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "title", "lines", "fields"])

    schema = "page_id long, title string, lines array<struct<tag: string, line: string, main: boolean>>, fields array<struct<name: string, value: string>>"
    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html")).mapInArrow(run, schema)


def main_lines(lines: Column, least: int = 100) -> Column:
    """Lines of the main container if they have over ``least`` characters, else all."""
    inner = F.filter(lines, lambda x: x["main"])
    chars = F.aggregate(inner, F.lit(0), lambda s, x: s + F.length(x["line"]))
    return F.when(chars > least, inner).otherwise(lines)


def without_repeats(lines: Column) -> Column:
    """Without lines equal to the one before."""
    return F.filter(lines, lambda x, i: (i == 0) | (F.get(lines, i - 1) != x))


def clean_html(pages: DataFrame) -> DataFrame:
    """``page_id, text``: main lines of 11 to 4,999 characters without consecutive repeats, parted by blank lines."""
    kept = F.filter(F.transform(main_lines(F.col("lines")), lambda x: x["line"]), lambda x: F.length(x).between(11, 4999))
    read = page_lines(pages).select("page_id", kept.alias("kept"))
    return read.select("page_id", F.array_join(without_repeats(F.col("kept")), "\n\n").alias("text"))


def documents_of(pages: DataFrame, most_repeats: int = 2) -> DataFrame:
    """``page_id, title, n_lines, n_headings, summary, fields, text``: numeric lines dropped, each line at most ``most_repeats`` times, headings marked with ``# ``."""
    read = page_lines(pages).select("page_id", "title", "fields", main_lines(F.col("lines")).alias("lines"))
    wanted = F.filter("lines", lambda x: ~x["line"].rlike(r"^[0-9\s.,:/-]*$"))
    counted = F.transform(wanted, lambda x, i: F.struct(x["tag"].alias("tag"), x["line"].alias("line"), F.size(F.filter(F.slice(wanted, 1, i), lambda y: y["line"] == x["line"])).alias("before")))
    kept = F.filter(counted, lambda x: x["before"] < most_repeats)
    rows = read.select("page_id", "title", F.map_from_entries(F.filter("fields", lambda f: f["name"] != "")).alias("fields"), kept.alias("kept"))
    shown = F.transform("kept", lambda x: F.when(x["tag"].rlike("^h[1-6]$"), F.concat(F.lit("# "), x["line"])).otherwise(x["line"]))
    long_lines = F.slice(F.filter(F.transform("kept", lambda x: x["line"]), lambda x: F.length(x) >= 40), 1, 3)
    return rows.select(
        "page_id", "title", F.size("kept").alias("n_lines"), F.size(F.filter("kept", lambda x: x["tag"].rlike("^h[1-6]$"))).alias("n_headings"),
        F.substring(F.array_join(long_lines, " "), 1, 450).alias("summary"), "fields", F.array_join(shown, "\n").alias("text"),
    )

"""Line deduplication across documents by range-partitioned hashes.

Each line long enough has a key (stripped, lower case).  Key hashes are dealt
to ranges of (hash, document, position), sorted within a range with the largest
document first, and streamed: the first document of a run of one hash keeps its
lines, and the lines of the others go once the run is known to span
``min_docs`` documents.  A range boundary may cut a run anywhere, so a hash
that a third of all lines share is spread over many tasks; a task then leaves
the lines of its first and last run open and reports their first documents,
and a table of these reports, with ``2 * min_docs`` rows a task at most,
settles them.

The result is a compressed bitmap of kept lines per document; texts are not
shuffled until a caller applies the bitmaps.

Keys are compared by two independent 64-bit hashes.  Edge cases: a null or
empty text is one empty line; a null id sorts as the smallest; rows that share
an id are one document for counting, and their bitmaps are told apart by a
hash of the text; documents without droppable lines have no bitmap; an empty
table gives no rows.  Columns other than the two named are not read by
``line_bitmaps`` and are carried by ``drop_lines``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import fresh, stored

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kinds of streamed rows: a line that goes, a line whose run a boundary cuts, a document of such a run.
DROP, OPEN, REPORT = 0, 1, 2


def text_tag(text: Column) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """A row for each line that may be dropped: ``a, b`` (hashes of its key), ``known, doc`` (document), ``tag, pos``."""
    lines = docs.select(
        F.col(doc_id).isNotNull().alias("known"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc"),
        text_tag(F.col(text)).alias("tag"),
        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"),
    )
    bare = F.btrim("line", F.lit(BLANKS))
    # folding A-Z keeps the length, so short lines go before it; on ASCII text it is ``lower``, which is faster
    long = lines.filter(F.length(bare) >= min_chars).select("known", "doc", "tag", "pos", bare.alias("bare"))
    key = F.when(F.octet_length("bare") == F.length("bare"), F.lower("bare")).otherwise(F.translate("bare", UPPER, LOWER))
    keyed = long.select("known", "doc", "tag", "pos", key.alias("key"))
    return keyed.select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit("second"), "key").alias("b"), "known", "doc", "tag", "pos")


_STREAMED = "kind int, a long, b long, known boolean, doc long, tag long, pos int"
_ARROW = pa.schema([
    ("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("known", pa.bool_()), ("doc", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32()),
])


_KEYS = ("a", "b", "known", "doc", "tag", "pos")
Rows = dict[str, np.ndarray]


def _out(kind: int, rows: Rows, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(mask)
    if len(at):
        columns = [np.full(len(at), kind, np.int32), *(rows[k][at] for k in _KEYS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def stream_runs(min_docs: int):
    """A mapper over the sorted rows ``a, b, known, doc, tag, pos`` of a range.

    Between batches it holds the unfinished run only: all its lines while they
    are of fewer than ``min_docs`` documents, then one line for each of its
    first ``min_docs`` documents (already passed on, kept to count by).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rows | None = None  # the unfinished run; "new" marks lines not yet passed on
        held_first = True  # whether it is the first run of this range
        for batch in batches:
            if not batch.num_rows:
                continue
            rows: Rows = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(_KEYS)}
            rows["new"] = np.ones(batch.num_rows, bool)
            if held is not None:
                rows = {k: np.concatenate((held[k], rows[k])) for k in rows}
            n = len(rows["a"])
            new_run = np.ones(n, bool)
            new_run[1:] = (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])
            new_doc = new_run.copy()
            new_doc[1:] |= (rows["doc"][1:] != rows["doc"][:-1]) | (rows["known"][1:] != rows["known"][:-1])
            number = np.cumsum(new_run) - 1
            upto = np.cumsum(new_doc)
            place = upto - upto[np.flatnonzero(new_run)][number] + 1  # of a line's document in its run
            docs = np.zeros(number[-1] + 1, np.int64)
            np.maximum.at(docs, number, place)
            last = number == number[-1]
            first = (number == 0) & held_first
            settled = ~first & (place > 1) & (docs[number] >= min_docs)
            yield from _out(DROP, rows, settled & rows["new"])
            yield from _out(OPEN, rows, first & rows["new"])
            if held_first and number[-1] > 0:
                yield from _out(REPORT, rows, first & new_doc & (place <= min_docs))
            held_first = held_first and number[-1] == 0
            passed = held_first or docs[-1] >= min_docs
            keep = last & new_doc & (place <= min_docs) if passed else last
            held = {k: v[keep] for k, v in rows.items()}
            if passed:
                held["new"] = np.zeros(int(keep.sum()), bool)
        if held is not None:
            yield from _out(OPEN, held, held["new"])
            starts = np.ones(len(held["doc"]), bool)
            starts[1:] = (held["doc"][1:] != held["doc"][:-1]) | (held["known"][1:] != held["known"][:-1])
            yield from _out(REPORT, held, starts)

    return run


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``known, doc, tag, pos`` of every line that goes."""
    order = [F.col("a"), F.col("b"), F.col("known").desc(), F.col("doc").desc(), F.col("tag"), F.col("pos")]
    # written first, as finding the ranges reads the keys once more
    keys = stored(line_keys(docs, doc_id, text, min_chars), "line-keys")
    dealt = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = stored(dealt.mapInArrow(stream_runs(min_docs), _STREAMED), "line-runs")
    who = F.struct("known", "doc")
    reports = streamed.filter(F.col("kind") == REPORT).groupBy("a", "b").agg(F.max(who).alias("keeper"), F.count_distinct(who).alias("n"))
    verdicts = reports.filter(F.col("n") >= min_docs).select("a", "b", "keeper")
    # a range reports on two runs at most, so the verdicts are bounded by the number of tasks
    cut = streamed.filter(F.col("kind") == OPEN).join(F.broadcast(verdicts), ["a", "b"]).filter(who < F.col("keeper"))
    columns = ["known", "doc", "tag", "pos"]
    return streamed.filter(F.col("kind") == DROP).select(*columns).unionByName(cut.select(*columns))


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """Compressed bitmap of kept lines up to the last dropped one (later lines are kept)."""
    bits = np.ones(int(dropped.max()) + 1, np.uint8)
    bits[dropped] = 0
    return zlib.compress(len(bits).to_bytes(4, "little") + np.packbits(bits, bitorder="little").tobytes())


def unpack_bitmap(bitmap: bytes) -> np.ndarray:
    raw = zlib.decompress(bitmap)
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=4), bitorder="little")[: int.from_bytes(raw[:4], "little")].astype(bool)


def line_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``known, doc, tag, keep``: the bitmap of kept lines of each document that loses some."""

    @F.pandas_udf("binary")
    def packed(positions: pd.Series) -> pd.Series:
        return positions.map(lambda p: pack_bitmap(np.asarray(p)))

    dropped = dropped_lines(docs, doc_id, text, min_chars, min_docs)
    lists = dropped.groupBy("known", "doc", "tag").agg(F.collect_set("pos").alias("positions"))
    return lists.select("known", "doc", "tag", packed("positions").alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: str | None = None, dropped: str | None = None) -> DataFrame:
    """``docs`` with kept lines only in ``text`` (untouched texts, null ones too, stay as they are).

    ``lines`` and ``dropped`` name new columns for the lines before dropping and those that went.
    """
    known, doc, tag, keep, done = fresh(docs, "known", "doc", "tag", "keep", "kept")

    @F.pandas_udf("text string, lines long, dropped long")
    def kept(texts: pd.Series, bitmaps: pd.Series) -> pd.DataFrame:
        out = []
        for t, bitmap in zip(texts, bitmaps, strict=True):
            if bitmap is None:
                out.append((t, 1 if t is None else t.count("\n") + 1, 0))
                continue
            own, keep = t.split("\n"), unpack_bitmap(bitmap)
            left = [line for line, k in zip(own, keep, strict=False) if k] + own[len(keep) :]
            out.append(("\n".join(left), len(own), len(own) - len(left)))
        return pd.DataFrame(out, columns=["text", "lines", "dropped"])

    keyed = docs.withColumns({
        known: F.col(doc_id).isNotNull(),
        doc: F.coalesce(F.col(doc_id).cast("long"), F.lit(0)),
        tag: text_tag(F.col(text)),
    })
    named = bitmaps.select(F.col("known").alias(known), F.col("doc").alias(doc), F.col("tag").alias(tag), F.col("keep").alias(keep))
    result = keyed.join(named, [known, doc, tag], "left").withColumn(done, kept(F.col(text), F.col(keep)))
    columns = [F.col(done)["text"].alias(c) if c == text else F.col(c) for c in docs.columns]
    counts = [F.col(done)[of].alias(name) for of, name in (("lines", lines), ("dropped", dropped)) if name]
    return result.select(*columns, *counts)


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` without the lines that go; same columns."""
    return apply_bitmaps(docs, line_bitmaps(docs, doc_id, text, min_chars, min_docs), doc_id, text)

"""Benchmark decontamination by the q-gram lemma.

An item of m characters that stands in a text with at most k edits shares at
least m - q + 1 - k q of its q-grams with it, all on neighbouring diagonals
(position in the text minus position in the item).  Shared q-grams are counted
in diagonal bands that overlap by k, so every such match lies within one band;
bands that reach the bound are regions to verify, by a banded alignment of the
item against the region.

Texts and items are compared in lower case with white space runs as one blank.
Items of fewer than ``min_chars`` characters allow no edits and must stand
between characters that are no letters or digits; items too short to have a
q-gram count only where they are the whole text.

Items go in blocks of bounded size: a block's q-gram table is built on the
driver and broadcast, and a task searches its texts for one block; more items
mean more blocks, not larger ones.  Equal items are searched once, under their
smallest id.  Shared q-grams are counted in slices of bounded size, and a band
is closed once the slices have passed it, so a q-gram that a text and an item
both repeat costs time but no memory.

Edge cases: null and empty texts and items match nothing; a null document id is
carried; rows that repeat are searched each; empty tables give no rows.
Columns other than the named ones are not read by ``find_items`` and are
carried by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.batches import small
from lodestone.llm.store import fresh, stored

PRIME = 0x9E3779B97F4A7C15
WRAP = (1 << 64) - 1
#: Bits of the first filter's table.
FILTER_BITS = 22
#: Characters of the items of a block.
BLOCK_CHARS = 4_000_000
#: Positions of a text that are hashed at a time, and shared q-grams that are counted at a time.
STEP, PAIRS = 1 << 20, 1 << 20
MATCHES = "item_id long, distance int, region_start int, region_end int"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each position on (a position in the last q - 1 has none), by doubling."""
    parts, width, offset, out = points.astype(np.uint64) + np.uint64(1), 1, 0, None
    power, left = PRIME, q
    while left:
        if left & 1:
            if out is None:
                out = parts[: len(points) - width + 1]
            else:
                n = len(points) - (offset + width) + 1
                out = out[:n] * np.uint64(power) + parts[offset : offset + n]
            offset += width
        left >>= 1
        if left:
            n = len(points) - 2 * width + 1
            parts = parts[:n] * np.uint64(power) + parts[width : width + n]
            power, width = power * power & WRAP, 2 * width
    return (out ^ (out >> np.uint64(29))) * np.uint64(PRIME)


@dataclass
class Items:
    """Search table of a block of items."""

    q: int
    ids: list[int]
    texts: list[str]
    whole: dict[str, int]  # items without a q-gram, and their ids
    strict: np.ndarray  # whether an item allows no edits and must stand between other characters than letters and digits
    edits: np.ndarray  # k of each item
    bound: np.ndarray  # shared q-grams that a match cannot have fewer of
    shift: np.ndarray  # a band begins every 2 ** shift diagonals
    hashes: np.ndarray  # of all q-grams, sorted
    item: np.ndarray
    place: np.ndarray
    coarse: np.ndarray  # which leading bits of a hash occur


def build(ids: list[int], texts: list[str], q: int, rate: float, min_chars: int = 40) -> Items:
    whole = {t: i for i, t in zip(ids, texts, strict=True) if len(t) < q}
    ids, texts = [i for i, t in zip(ids, texts, strict=True) if len(t) >= q], [t for t in texts if len(t) >= q]
    length = np.array([len(t) for t in texts], np.int64)
    strict = length < min_chars
    edits = np.where(strict, 0, np.minimum((length * rate).astype(np.int64), (length - q) // q))  # keeps the bound at 1 or more
    found = [gram_hashes(codes(t), q) for t in texts]
    hashes = np.concatenate([np.zeros(0, np.uint64), *found])
    item = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in found)])
    order = np.argsort(hashes, kind="stable")
    coarse = np.zeros(1 << FILTER_BITS, bool)
    coarse[hashes >> np.uint64(64 - FILTER_BITS)] = True
    shift = np.ceil(np.log2(edits + 1)).astype(np.int64) + 1
    return Items(q, ids, texts, whole, strict, edits, length - q + 1 - q * edits, shift, hashes[order], item[order], place[order], coarse)


def shared_grams(points: np.ndarray, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place before which all is told, item, position, diagonal) of the q-grams that the characters share with items, in slices."""
    for base in range(0, len(points) - items.q + 1, STEP):
        hashes = gram_hashes(points[base : base + STEP + items.q - 1], items.q)
        at = np.flatnonzero(items.coarse[hashes >> np.uint64(64 - FILTER_BITS)])
        low = np.searchsorted(items.hashes, hashes[at], "left")
        hit = low < len(items.hashes)
        at, low = at[hit], low[hit]
        hit = items.hashes[low] == hashes[at]
        at, low = at[hit], low[hit]
        many = np.searchsorted(items.hashes, hashes[at], "right") - low
        upto = np.cumsum(many)
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, "right")))
            part = slice(first, last)
            some = many[part]
            entry = np.repeat(low[part] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))
            position = np.repeat(at[part], some) + base
            yield base + int(at[last - 1]) + 1, items.item[entry], position, position - items.place[entry]
            first = last


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, weights=counts, minlength=len(found)).astype(np.int64)


def regions(points: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(item, first diagonal, last diagonal) of the bands that reach the bound, neighbours merged."""
    if not items.texts:
        return []
    reach = np.array([len(t) for t in items.texts], np.int64) + 1  # added to an item's diagonals, none of them is negative
    low40 = (1 << 40) - 1
    keys, counts, good = np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.int64)]
    for upto, item, _, diagonal in shared_grams(points, items):
        shift = items.shift[item]
        place = diagonal + reach[item]
        band = place >> shift
        inside = place - (band << shift)
        over = inside < items.edits[item]  # also in the band before, which reaches k diagonals further
        key = np.concatenate((keys, item << np.int64(40) | band + 1, item[over] << np.int64(40) | band[over]))
        keys, counts = summed(key, np.concatenate((counts, np.ones(len(key) - len(keys), np.int64))))
        owner = keys >> 40
        closed = ((keys & low40) << items.shift[owner]) + items.edits[owner] < upto  # its last diagonal and the item's length
        good.append(keys[closed & (counts >= items.bound[owner])])
        keys, counts = keys[~closed], counts[~closed]
    good.append(keys[counts >= items.bound[keys >> 40]])
    out: list[tuple[int, int, int]] = []
    for key in np.sort(np.concatenate(good)).tolist():
        i, b = key >> 40, (key & low40) - 1
        first = (b << int(items.shift[i])) - int(reach[i])
        last = first + (1 << int(items.shift[i])) + int(items.edits[i]) - 1
        if out and out[-1][0] == i and first <= out[-1][2] + 1:
            out[-1] = (i, out[-1][1], last)
        else:
            out.append((i, first, last))
    return out


def banded_distance(item: np.ndarray, region: np.ndarray, most: int) -> int | None:
    """Edits between ``item`` and the best part of ``region``, or None beyond ``most``.

    Row i holds the costs of the first i characters of the item ending at each
    diagonal of the region; only diagonals that the region spans are kept.
    """
    m, width = len(item), len(region) - len(item)
    if width < 0:
        region = np.concatenate((region, np.full(-width, -1, region.dtype)))
        width = 0
    span = width + 1
    steps = np.arange(span)
    far = m + len(region) + 1
    row = np.zeros(span, np.int64)  # starting anywhere is free
    for i in range(m):
        match = row + (region[i : i + span] != item[i])
        skip = np.append(row[1:] + 1, far)  # a character of the item is left out: the diagonal before
        best = np.minimum(match, skip)
        row = np.minimum.accumulate(best - steps) + steps  # characters of the region are left out
        if row.min() > most:
            return None
    found = int(row.min())
    return found if found <= most else None


def stands_alone(item: str, text: str, start: int, end: int) -> bool:
    """Whether ``item`` stands within a part of ``text`` with no letter or digit before or after it."""
    at = text.find(item, start, end)
    while at >= 0:
        after = at + len(item)
        if not (at and text[at - 1].isalnum() and item[0].isalnum()) and not (after < len(text) and text[after].isalnum() and item[-1].isalnum()):
            return True
        at = text.find(item, at + 1, end)
    return False


def verified(text: str, found: list[tuple[int, int, int]], items: Items) -> dict[int, tuple[int, int, int]]:
    """item -> (distance, start, end of the region) of the regions that align within the edits of their item."""
    out: dict[int, tuple[int, int, int]] = {}
    for i, first, last in found:
        item, k = items.texts[i], int(items.edits[i])
        start, end = max(0, first - k), min(len(text), last + len(item) + k)
        region = text[start:end]
        if items.strict[i]:
            distance = 0 if stands_alone(item, text, start, end) else None
        elif item in region:
            distance = 0
        else:
            # characters may be missing at either end of a text: blanks of the alignment stand for them
            wide = np.concatenate((np.full(k, -1), codes(region).astype(np.int64), np.full(k, -1)))
            distance = banded_distance(codes(item).astype(np.int64), wide, k)
        if distance is not None and (i not in out or distance < out[i][0]):
            out[i] = (distance, start, end)
    return out


def search(texts: list[str | None], items: Items, chars: int = 1_000_000) -> Iterator[list[tuple[int, int, int, int]]]:
    """Matches of each text: (item id, distance, start, end)."""
    held: list[str] = []
    size = 0

    def flush() -> Iterator[list[tuple[int, int, int, int]]]:
        starts = np.cumsum([0, *(len(t) + 1 for t in held)])
        points = codes("\0".join(held))
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, item, position, _ in shared_grams(points, items):
            owner = np.searchsorted(starts, position, "right") - 1
            key = np.concatenate((keys, owner * len(items.texts) + item))
            keys, counts = summed(key, np.concatenate((counts, np.ones(len(key) - len(keys), np.int64))))
        # a text with fewer shared q-grams of an item than its bound has no region of it
        wanted = set((keys[counts >= items.bound[keys % len(items.texts)]] // len(items.texts)).tolist()) if len(keys) else set()
        for k, text in enumerate(held):
            found = verified(text, regions(points[starts[k] : starts[k] + len(text)], items), items) if k in wanted else {}
            same = [(items.whole[text], 0, 0, len(text))] if text in items.whole else []
            yield same + [(items.ids[i], *where) for i, where in sorted(found.items())]

    for text in texts:
        held.append(normal(text or ""))
        size += len(held[-1])
        if size >= chars:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[list[int], list[str]]]:
    """Distinct normalised items with their smallest id, a block of about ``BLOCK_CHARS`` characters at a time."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else normal(t))

    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), plain(F.col(item_text)).alias("text")).filter("text <> ''")
    items = stored(items.groupBy("text").agg(F.min("item_id").alias("item_id")), "items")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_CHARS)
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        if block:
            yield [r["item_id"] for r in block], [r["text"] for r in block]


def matched(docs: DataFrame, shared: Broadcast, text: str, column: str) -> DataFrame:
    """``docs`` with ``column``: the items of one broadcast block found in each text, an array of ``MATCHES`` structs; no shuffle."""
    keys = ("item_id", "distance", "region_start", "region_end")
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), *((k, pa.int32()) for k in keys[1:])]))
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T._parse_datatype_string(f"struct<{MATCHES}>")))])
    names, at = schema.names, docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = search(batch.column(at).to_pylist(), shared.value)
            lists = [[dict(zip(keys, m, strict=True)) for m in one] for one in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, arrow)], names=names)

    return docs.mapInArrow(run, schema)


def _blocks(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, q: int, rate: float, min_chars: int) -> list[Broadcast]:
    context = docs.sparkSession.sparkContext
    return [context.broadcast(build(ids, texts, q, rate, min_chars)) for ids, texts in item_blocks(benchmark, item_id, item_text)]


def find_items(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 8, rate: float = 0.1, min_chars: int = 40
) -> DataFrame:
    """``doc_id, item_id, distance, region_start, region_end`` of every item found; regions lie in the normalised text.

    Each block of items is a pass over the texts of its own, so that a task holds one block.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    none = rows.select("doc_id", F.lit(None).cast(f"struct<{MATCHES}>").alias("m")).limit(0)
    passes = [
        matched(rows, shared, "text", "matches").select("doc_id", F.explode("matches").alias("m"))
        for shared in _blocks(docs, benchmark, item_id, item_text, q, rate, min_chars)
    ]
    return reduce(DataFrame.unionByName, passes or [none]).select("doc_id", "m.*")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = 8, rate: float = 0.1, min_chars: int = 40
) -> DataFrame:
    """``docs`` without those that hold an item; same columns.

    One block of items is a filter.  With several, each finds texts in a pass
    of its own, and two hashes of these texts are taken out of ``docs`` by a join.
    """
    blocks = _blocks(docs, benchmark, item_id, item_text, q, rate, min_chars)
    column, a, b = fresh(docs, "matches", "a", "b")
    if len(blocks) == 1:
        return matched(docs, blocks[0], text, column).filter(F.size(column) == 0).select(*docs.columns)
    if not blocks:
        return docs
    hashes = [F.xxhash64(F.coalesce(text, F.lit(""))).alias(a), F.xxhash64(F.lit("second"), F.coalesce(text, F.lit(""))).alias(b)]
    rows = docs.select(*hashes, F.col(text).alias(column + "_text"))
    passes = [matched(rows, shared, column + "_text", column).filter(F.size(column) > 0).select(a, b) for shared in blocks]
    found = stored(reduce(DataFrame.unionByName, passes).distinct(), "contaminated")
    return docs.select("*", *hashes).join(found, [a, b], "left_anti").select(*docs.columns)

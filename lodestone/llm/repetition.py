"""Quality rules with suffix-array repetition.

Base rules count words, symbols, repeated lines and words in repeated 8-word
windows.  The method's verdict comes from the suffix array of a text's words:
neighbours in it share the longest common prefixes, whose intervals are the
maximal repeated substrings.  Their spans are united, and a text fails if they
cover too large a share of its words or if one of them is too long.

Suffix arrays are built for many texts at once: symbols are numbered within
their text, so no prefix is shared across texts, and prefix doubling sorts all
suffixes of a slice together, going on with those whose order is still open.

Edge cases: a null text has no words; a null id is carried; words are runs of
anything but ASCII white space; very long texts are handled whole, alone in
their slice; repeated rows are judged each; an empty table gives no rows.
Columns other than the two named are not read by ``measure_texts`` and are
carried by ``keep_good``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.batches import small

#: Words of a window of the base rule, as a power of two (2 ** 3 = 8).
WINDOW_LEVEL = 3
SYMBOLS = str.maketrans("", "", "#*$%&|<>")
BLANKS = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Limits:
    """A text is rejected under ``min_words``, over ``max_repeat_share`` of words in repeated 8-word windows (base
    rules), or when maximal repeats of ``min_repeat`` words or more cover over ``max_covered`` of its words or one of
    them has over ``max_repeat`` words (the method's verdict)."""

    min_words: int = 20
    max_repeat_share: float = 0.30
    min_repeat: int = 5
    max_covered: float = 0.30
    max_repeat: int = 50


def suffix_array(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order of texts laid end to end, and the ranks of all suffixes by their first 1, 2, 4, ... symbols.

    ``symbols`` must differ between texts; ``ends`` is, at each position, where
    its text ends.  Two suffixes of equal rank at a level agree in that many symbols.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int64)
    ordered = symbols[order]
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = heads
    levels, reach = [rank], 1
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_):
        own = order[open_]
        ahead = own + reach
        inside = ahead < ends[own]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        by = np.lexsort((second, rank[own]))
        own, second, first = own[by], second[by], rank[own][by]
        order[open_] = own
        new = np.empty(len(own), bool)
        new[0] = True
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        heads = open_[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        rank = rank.copy()
        rank[own] = heads
        levels.append(rank)
        open_ = open_[~(new & np.append(new[1:], True))]
        reach *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Symbols that each suffix of the order shares with the one before it (0 at the first)."""
    shared = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return shared
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b = order[pairs - 1].copy(), order[pairs].copy()
    n = len(order)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        same = (a < n) & (b < n) & (level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)])
        step = same.astype(np.int64) << k
        shared[pairs] += step
        a += step
        b += step
    return shared


def longest_repeats(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Length of the longest repeat that starts at each position: the deepest common-prefix interval around its suffix."""
    longest = np.zeros(len(order), np.int64)
    longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + lengths, -1)
    return np.cumsum(marks[:-1]) > 0


def measure(texts: list[str], min_repeat: int) -> dict[str, list[int]]:
    """Counts of each text."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    found: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines")}
    parts, sizes = [], []
    for text in texts:
        raw = text.encode()
        words = raw.split()
        sizes.append(len(words))
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        found["n_words"].append(len(words))
        found["word_chars"].append(len(text) - (len(raw) - sum(map(len, words))))
        found["n_symbols"].append(len(text) - len(text.translate(SYMBOLS)) if not text.isascii() else len(raw) - len(raw.translate(None, b"#*$%&|<>")))
        lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
        found["n_dup_lines"].append(len(lines) - len(set(lines)))
    size = np.array(sizes, np.int64)
    n, begins = int(size.sum()), np.concatenate(([0], np.cumsum(size)))[:-1]
    owner = np.repeat(np.arange(len(texts)), size)
    symbols = np.concatenate(parts) + owner * len(ids) if n else np.zeros(0, np.int64)
    order, levels = suffix_array(symbols, np.repeat(begins + size, size))
    shared = common_prefixes(order, levels)
    longest = longest_repeats(order, shared)
    window = 1 << WINDOW_LEVEL
    for name, least, width in (("n_repeat_words", window, window), ("n_covered", min_repeat, None)):
        starts = np.flatnonzero(longest >= least)
        spans = covered(starts, np.full(len(starts), width) if width else longest[starts], n)
        found[name] = np.bincount(owner[spans], minlength=len(texts)).tolist()
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, owner, longest)
    found["longest_repeat"] = top.tolist()
    return found


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def _slices(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def measured(df: DataFrame, text: str = "text", prefix: str = "", limits: Limits = Limits()) -> DataFrame:
    """``df`` with the counts and verdicts of each text, each column named with ``prefix``; no shuffle."""
    names = [prefix + name for name in _NAMES]
    schema = T.StructType(list(df.schema.fields))
    for name in names:
        schema = schema.add(name, "long")
    source = text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = ["" if t is None else t for t in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            totals: dict[str, list[int]] = {name: [] for name in _NAMES}
            for part in _slices(texts):
                for name, values in measure(part, limits.min_repeat).items():
                    totals[name] += values
            arrays = [*batch.columns, *(pa.array(totals[name], pa.int64()) for name in _NAMES)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *names])

    out = df.mapInArrow(run, schema)
    c = {name: F.col(prefix + name) for name in _NAMES}
    share = F.lit(100) * c["n_repeat_words"] > F.lit(round(100 * limits.max_repeat_share)) * c["n_words"]
    failed = (c["n_words"] < limits.min_words) | share
    repeats = (F.lit(100) * c["n_covered"] > F.lit(round(100 * limits.max_covered)) * c["n_words"]) | (c["longest_repeat"] > limits.max_repeat)
    return out.withColumn(prefix + "base_failed", failed).withColumn(prefix + "kept", ~failed & ~repeats)


def measure_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return measured(rows, limits=limits).drop("text")


def keep_good(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents that pass all rules, with the columns they came with."""
    columns = docs.columns
    prefix = "rule_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return measured(docs, text, prefix, limits).filter(F.col(prefix + "kept")).select(*columns)

"""How the sources of a language differ in their use of terms, from a single-pass in-memory index.

A task reads its documents once and keeps a block of postings in memory: for
each term of a language in how many documents it stands and how often in each
source.  When the block is full it is spilled as a run: cut into hash shards,
sorted by term and passed on in segments.  A shard's task gets the segments of
all runs in order of their first terms, so it opens a segment when the merge
arrives there, and merges the open ones with a heap into frequencies.  What is
shuffled are counts: a third of all rows in one source, or one word in every
document, add no more than a number to a run.

A term's share in a source is an integer, ``1 + floor(10 ** 9 * (count +
smoothing) / (N + smoothing * V))``, over the V terms that its language keeps.
Terms that a source lacks all have one share, so the distance of two sources is
V times the difference of these, corrected for each term that stands in one of
them.  The corrections stream term by term through tasks that hold the sums of
a tile of source pairs; tiles bound the memory, whatever the number of sources.

Edge cases: null text, language and source count as empty; a document without
terms still makes its group occur; repeated rows are documents each; a language
without kept terms has distances of 0 and no terms; a source alone in its
language has no pairs; very long texts are cut up at blanks while they are
counted, and a very long term is one term; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import small
from lodestone.llm.store import stored

#: Bytes of a block of postings, and what an entry counts besides its term.
BLOCK_BYTES, ENTRY_BYTES = 96 << 20, 120
#: Terms and bytes of a segment; bytes of a text that are split into terms at a time.
SEGMENT_TERMS, SEGMENT_BYTES, PART_BYTES = 4096, 256 << 10, 1 << 20
#: Sums of source pairs that a task holds; counts of terms that one task corrects them by, about.
TILE, TASK_ENTRIES = 1 << 20, 500_000
#: Of shares; and counts from which the product exceeds a long.
UNIT, LARGEST = 1_000_000_000, 9_000_000_000
#: A-Z to lower case; what is ASCII and no letter parts terms.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def parts(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; parts end where terms do."""
    plain = text.translate(LETTERS)
    at = 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= PART_BYTES else plain.find(b" ", at + PART_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


class Block:
    """Postings in memory.  The empty term, which no text holds, counts the documents of a group."""

    def __init__(self, shards: int):
        self.shards = shards
        self.clear()

    def clear(self) -> None:
        self.bytes = 0
        self.documents: dict[bytes, Counter] = {}
        self.counts: dict[bytes, dict[bytes, Counter]] = {}

    def add(self, language: bytes, source: bytes, text: bytes) -> None:
        documents = self.documents.setdefault(language, Counter())
        sources = self.counts.setdefault(language, {})
        counts = sources.get(source)
        if counts is None:
            counts = sources[source] = Counter()
            self.bytes += ENTRY_BYTES + len(source)
        before = len(documents) + len(counts)
        distinct = {b""}
        for terms in parts(text):
            counts.update(terms)
            distinct.update(terms)
        counts[b""] += 1
        documents.update(distinct)
        grown = len(documents) + len(counts) - before
        if grown:
            self.bytes += grown * ENTRY_BYTES + min(grown * max(map(len, distinct)), len(text))

    def spill(self) -> Iterator[pa.RecordBatch]:
        """The block as a run: segments in order of (shard, term), a language at a time."""
        for language in sorted(self.documents):
            documents, salt = self.documents[language], zlib.crc32(language)
            terms = sorted(documents)
            shards = np.fromiter((zlib.crc32(term, salt) for term in terms), np.uint32, len(terms)) % self.shards
            order = np.argsort(shards, kind="stable")
            shards, terms = shards[order].tolist(), [terms[i] for i in order.tolist()]
            place = dict(zip(terms, range(len(terms)), strict=True))
            names = sorted(self.counts[language])
            held = [self.counts[language][name] for name in names]
            sizes = [len(c) for c in held]
            at = np.fromiter(map(place.__getitem__, chain.from_iterable(held)), np.int64, sum(sizes))
            n = np.fromiter(chain.from_iterable(c.values() for c in held), np.int64, sum(sizes))
            order = np.argsort(at, kind="stable")
            source, n = np.repeat(np.arange(len(names)), sizes)[order], n[order]
            entries = np.bincount(at, minlength=len(terms))
            ends = np.cumsum(entries)
            for first, last in segments(shards, terms):
                mine = terms[first:last]
                begin, end = ends[first] - entries[first], ends[last - 1]
                own, inside = np.unique(source[begin:end], return_inverse=True)
                columns = (
                    ([shards[first]], pa.int32()), ([language], pa.binary()), ([mine[0]], pa.binary()), ([mine], pa.list_(pa.binary())), ([list(map(documents.__getitem__, mine))], pa.list_(pa.int64())),
                    ([entries[first:last]], pa.list_(pa.int32())), ([[names[i] for i in own]], pa.list_(pa.binary())), ([inside], pa.list_(pa.int32())), ([n[begin:end]], pa.list_(pa.int64())),
                )
                yield pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], names=["shard", "lang", "first", "terms", "documents", "sizes", "names", "sources", "counts"])
        self.clear()


def segments(shards: list[int], terms: list[bytes]) -> Iterator[tuple[int, int]]:
    """``first, last`` of the slices that make a segment each."""
    first = size = 0
    for i, (shard, term) in enumerate(zip(shards, terms, strict=True)):
        if i > first and (shard != shards[first] or i - first >= SEGMENT_TERMS or size + len(term) > SEGMENT_BYTES):
            yield first, i
            first, size = i, 0
        size += len(term)
    if terms:
        yield first, len(terms)


RUN = "shard int, lang binary, first binary, terms array<binary>, documents array<bigint>, sizes array<int>, names array<binary>, sources array<int>, counts array<bigint>"


def runs(docs: DataFrame, shards: int, lang: str = "lang", source: str = "source", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Segments of term-sorted runs, a run for each block that a task fills."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shards)
        for batch in small(batches):
            for row in zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns), strict=True):
                block.add(*row)
                if block.bytes >= block_bytes:
                    yield from block.spill()
        yield from block.spill()

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    return docs.select(*plain).mapInArrow(read, RUN)


class Segment:
    """A segment that the merge has opened, and where it stands in it."""

    def __init__(self, row: dict):
        self.terms = row["terms"].to_numpy(zero_copy_only=False).tolist()
        self.documents = row["documents"].to_numpy().tolist()
        self.sizes = row["sizes"].to_numpy()
        self.ends = np.cumsum(self.sizes)
        self.names = row["names"].to_numpy(zero_copy_only=False).tolist()
        self.sources, self.counts = row["sources"].to_numpy(), row["counts"].to_numpy()
        self.at = 0
        #: Numbers of the terms passed since the last table, by their places in it.
        self.passed: list[int] = []


class Merge:
    """Heap-merge of the runs of a shard: terms in order, with the sums of their postings."""

    def __init__(self, fewest: int, most: int = 10_000):
        self.fewest, self.most = fewest, most
        self.heap: list = []
        self.used: list[Segment] = []
        self.terms: list[bytes] = []
        self.documents: list[int] = []

    def open(self, no: int, segment: Segment) -> None:
        heapq.heappush(self.heap, (segment.terms[0], no, segment))
        self.used.append(segment)

    def advance(self, until: bytes | None) -> Iterator[tuple[list[bytes], list[list[bytes]], list[np.ndarray]]]:
        """``terms, names, counts`` of what is complete once all terms below ``until`` have passed."""
        while self.heap and (until is None or self.heap[0][0] < until):
            term, no, segment = self.heap[0]
            if not self.terms or self.terms[-1] != term:
                if len(self.terms) >= self.most:
                    yield self.table()
                self.terms.append(term)
                self.documents.append(0)
            self.documents[-1] += segment.documents[segment.at]
            segment.passed.append(len(self.terms) - 1)
            segment.at += 1
            if segment.at < len(segment.terms):
                heapq.heapreplace(self.heap, (segment.terms[segment.at], no, segment))
            else:
                heapq.heappop(self.heap)
        if until is None and self.terms:
            yield self.table()

    def table(self) -> tuple[list[bytes], list[list[bytes]], list[np.ndarray]]:
        """Sums the postings of the terms that have passed; those of too few documents are left out."""
        names = sorted({name for s in self.used for name in s.names})
        number = {name: i for i, name in enumerate(names)}
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in self.used:
            if s.passed:
                first = s.at - len(s.passed)
                begin, end = s.ends[first] - s.sizes[first], s.ends[s.at - 1]
                own = np.array([number[name] for name in s.names])[s.sources[begin:end]]
                keys.append(np.repeat(s.passed, s.sizes[first : s.at]) * len(names) + own)
                counts.append(s.counts[begin:end])
                s.passed = []
        self.used = [s for s in self.used if s.at < len(s.terms)]
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, where, np.concatenate(counts))
        ends = np.searchsorted(found, np.arange(1, len(self.terms) + 1) * len(names)).tolist()
        out: tuple[list, list, list] = ([], [], [])
        begin = 0
        for term, documents, end in zip(self.terms, self.documents, ends, strict=True):
            if documents >= self.fewest or not term:
                out[0].append(term)
                out[1].append([names[i] for i in (found[begin:end] % len(names)).tolist()])
                out[2].append(sums[begin:end])
            begin = end
        self.terms, self.documents = [], []
        return out


def merged(rows: Iterable[dict], fewest: int) -> Iterator[tuple[bytes, list[bytes], list[list[bytes]], list[np.ndarray]]]:
    """``language, terms, sources, counts`` from segments that come in order of (shard, language, first term)."""
    at, merge = None, Merge(fewest)
    for no, row in enumerate(rows):
        if (row["shard"], row["lang"]) != at:
            for table in merge.advance(None):
                yield at[1], *table
            at = (row["shard"], row["lang"])
        else:
            for table in merge.advance(row["first"]):
                yield at[1], *table
        merge.open(no, Segment(row))
    for table in merge.advance(None):
        yield at[1], *table


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of the batches; lists stay Arrow arrays."""
    for batch in small(batches, 64):
        for i in range(batch.num_rows):
            yield {name: c[i].values if pa.types.is_list(c.type) else c[i].as_py() for name, c in zip(batch.schema.names, batch.columns, strict=True)}


def frequencies(docs: DataFrame, fewest: int = 30, **names) -> DataFrame:
    """``lang, term, sources, counts``: the sources that hold each term of at least ``fewest`` documents and how often; the empty term counts the documents of each source."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spilled = stored(runs(docs, shards, **names), "runs")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, terms, sources, counts in merged(rows_of(batches), fewest):
            columns = [pa.array([language] * len(terms), pa.binary()), pa.array(terms, pa.binary()), pa.array(sources, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "sources", "counts"])

    ordered = spilled.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "lang", "first")
    found = ordered.mapInArrow(merge, "lang binary, term binary, sources array<binary>, counts array<bigint>")
    plain = [F.col("lang").cast("string").alias("lang"), F.col("term").cast("string").alias("term"), F.col("sources").cast("array<string>").alias("sources"), "counts"]
    return stored(found.select(*plain), "frequencies")


def share(count: Column, total: Column, terms: Column, smoothing: int) -> Column:
    """The integer share of a term; in decimals where the product exceeds a long."""
    parts = total + smoothing * terms
    wide = (count + smoothing).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return 1 + F.when(count < LARGEST, F.call_function("div", (count + smoothing) * UNIT, parts)).otherwise(F.call_function("div", wide, parts.cast("decimal(20,0)")))


def _groups(found: DataFrame, smoothing: int) -> DataFrame:
    """``lang, source, no, n_sources, total, terms, lang_total, n_rows``: a row for each occurring group, numbered within its language."""
    kept = found.filter("term <> ''")
    by_group = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    occurring = found.filter("term = ''").select("lang", F.explode("sources").alias("source"))
    numbered = occurring.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0)
    own = Window.partitionBy("lang")
    return stored(numbered.withColumns({"no": F.row_number().over(own.orderBy("source")) - 1, "n_sources": F.count(F.lit(1)).over(own), "lang_total": F.sum("total").over(own)}), "groups")


def pair_sums(kept: DataFrame, groups: DataFrame, smoothing: int) -> DataFrame:
    """``lang, no, other, value``: the distance of each two sources of a language, from ``kept(lang, term, sources, counts)``.

    A language's sources are cut into tiles and its terms dealt to some tasks
    each; a task gets the language's sources first and then a term a row.
    """
    rows = lambda n: F.greatest(F.lit(1), F.floor(F.lit(TILE) / n)).cast("int")  # noqa: E731  sources of a tile
    ordered = F.array_sort(F.collect_list(F.struct("no", "source", "total")))
    about = groups.groupBy("lang").agg(F.max("n_sources").alias("n"), F.max("terms").alias("terms"), ordered.alias("o"))
    about = about.select("lang", "n", "terms", F.col("o.source").alias("sources"), F.col("o.total").alias("totals"))
    about = about.withColumns({"tiles": F.ceil(F.col("n") / rows(F.col("n"))).cast("int"), "salts": F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("terms") / TASK_ENTRIES)).cast("int")})
    ranges = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    heads = about.select("*", ranges).select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    heads = heads.select("lang", "tile", "salt", rows(F.col("n")).alias("rows"), "terms", "sources", F.col("totals").alias("counts"))
    salt = F.pmod(F.xxhash64("term"), "salts").cast("int").alias("salt")
    lines = kept.join(about.select("lang", "tiles", "salts"), "lang").select("*", ranges).select("lang", "tile", salt, F.lit(0).alias("rows"), F.lit(0).cast("long").alias("terms"), "sources", "counts")

    def correct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for row in rows_of(batches):
            if row["rows"]:
                if tile is not None:
                    yield from tile.batches()
                tile = Tile(row["lang"], row["sources"].to_pylist(), row["counts"].to_numpy(), row["terms"], smoothing, row["tile"] * row["rows"], row["rows"], row["salt"] == 0)
            else:
                tile.add(row["sources"].to_pylist(), row["counts"].to_numpy())
        if tile is not None:
            yield from tile.batches()

    keys = ["lang", "tile", "salt"]
    dealt = heads.unionByName(lines).repartition(*keys).sortWithinPartitions(*keys, F.desc("rows"))
    sums = dealt.mapInArrow(correct, "lang string, no int, other int, value bigint")
    return sums.groupBy("lang", "no", "other").agg(F.sum("value").alias("value"))


class Tile:
    """Sums of absolute differences between some sources of a language and all of them."""

    def __init__(self, lang: str, sources: list[str], totals: np.ndarray, terms: int, smoothing: int, first: int, rows: int, whole: bool):
        self.lang, self.smoothing, self.first = lang, smoothing, first
        self.number = {name: i for i, name in enumerate(sources)}
        self.parts = totals + smoothing * terms
        self.absent = self.shares(np.zeros(len(totals), np.int64), self.parts) if terms else np.zeros(len(totals), np.int64)
        self.own = self.absent[first : first + rows]
        self.plain = np.abs(self.own[:, None] - self.absent[None, :])
        # one of the tasks that share a tile's terms begins with the distances that all terms would add if none were there
        self.sums = self.plain * (terms if whole else 0)

    def shares(self, counts: np.ndarray, parts: np.ndarray) -> np.ndarray:
        if counts.max(initial=0) >= LARGEST:
            counts = counts.astype(object)
        return (1 + (counts + self.smoothing) * UNIT // parts).astype(np.int64)

    def add(self, names: list[str], counts: np.ndarray) -> None:
        """Correct the sums by a term: all rows where a column holds it, then rows that hold it where none does."""
        holders = np.array([self.number[name] for name in names])
        shares = self.shares(counts, self.parts[holders])
        now = self.absent.copy()
        now[holders] = shares
        mine = now[self.first : self.first + len(self.own)]
        self.sums[:, holders] += np.abs(mine[:, None] - shares[None, :]) - self.plain[:, holders]
        inside = holders[(holders >= self.first) & (holders < self.first + len(self.own))] - self.first
        more = np.abs(mine[inside, None] - now[None, :]) - self.plain[inside]
        more[:, holders] = 0
        self.sums[inside] += more

    def batches(self, most: int = 100_000) -> Iterator[pa.RecordBatch]:
        rows, columns = self.sums.shape
        step = max(1, most // max(columns, 1))
        for at in range(0, rows, step):
            part = self.sums[at : at + step]
            no, other = (x.ravel() for x in np.indices(part.shape))
            no = no + at + self.first
            apart = no != other
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * int(apart.sum()), pa.string()), pa.array(no[apart].astype(np.int32)), pa.array(other[apart].astype(np.int32)), pa.array(part.ravel()[apart])], names=["lang", "no", "other", "value"])


def audit(docs: DataFrame, fewest: int = 30, smoothing: int = 5, most_terms: int = 50, **names) -> DataFrame:
    """``lang, source, part, item, value, rank``: the distances of a source from each other one of its language (``pair``) and the terms it uses more than the language (``term``, the first ``most_terms``)."""
    found = frequencies(docs, fewest, **names)
    groups, kept = _groups(found, smoothing), found.filter("term <> ''")
    whole = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    single = kept.select("lang", "term", whole.alias("n_lang"), F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "n_lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    joined = single.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    priced = joined.withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms"), smoothing), "q": share(F.col("n_lang"), F.col("lang_total"), F.col("terms"), smoothing)})
    above = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    named = lambda no, name: groups.select("lang", F.col("no").alias(no), F.col("source").alias(name))
    pairs = pair_sums(kept, groups, smoothing).join(named("no", "source"), ["lang", "no"]).join(named("other", "item"), ["lang", "other"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_terms)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first)

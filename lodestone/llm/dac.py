"""Directly addressable codes for token ids.

An id is split into 8-bit chunks, lowest first.  Level 0 holds the first chunk
of every id and a bitmap that says which ids go on; level 1 the second chunk of
those that do, and so on.  The place of an id's next chunk is the rank of its
bit, found from a directory of counts before every 512 bits, so the token at
any position is read in one step a level and no block is decoded.

Layout of a segment, little-endian: ``b"DAC1"``, u32 levels, then for each
level u64 chunks and u8 ``more`` (a bitmap follows), then the chunks (one byte
each) and, if ``more``, the bitmap (bit i of byte i // 8) and u32 counts.

On a cluster the segments are rows of a Parquet table in the shared folder, so
that writing is committed and retried by Spark and works on any store.

Edge cases: a null text is empty; a null id sorts first; repeated rows are
documents of their own, ordered by id and then by a hash of the text; an empty
table gives an empty code table.  Columns other than the two named are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import small
from lodestone.llm.tokens import encoded, memory

MAGIC = b"DAC1"
#: Bits from one count of the rank directory to the next.
BLOCK = 512
#: A segment ends after the document that brings it to so many ids or documents.
SEGMENT_TOKENS, SEGMENT_DOCS = 1_000_000, 50_000

CODES_SCHEMA = "part int, seq int, part_offset long, n_tokens long, doc_ids array<long>, doc_ends array<long>, codes binary"
TEXTS_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def encode(ids: np.ndarray) -> bytes:
    """A segment of unsigned ids below 2^32."""
    heads, bodies, rest = [], [], np.asarray(ids, np.uint32)
    while True:
        chunks, higher = (rest & 255).astype(np.uint8), rest >> 8
        more = higher > 0
        going_on = bool(more.any())
        heads.append(struct.pack("<QB", len(chunks), going_on))
        bodies.append(chunks.tobytes())
        if not going_on:
            break
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, np.uint8)
        padded[: len(more)] = more
        counts = np.concatenate(([0], np.cumsum(padded.reshape(-1, BLOCK).sum(1, dtype=np.uint64))))[:-1]
        bodies += [bits.tobytes(), counts.astype("<u4").tobytes()]
        rest = higher[more]
    return MAGIC + struct.pack("<I", len(heads)) + b"".join(heads) + b"".join(bodies)


class Segment:
    """Random access into an encoded segment; nothing is decoded but what is asked for."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (levels,) = struct.unpack_from("<I", blob, 4)
        at, self.levels = 8 + 9 * levels, []
        for k in range(levels):
            n, more = struct.unpack_from("<QB", blob, 8 + 9 * k)
            chunks = np.frombuffer(blob, np.uint8, n, at)
            at += n
            bits = counts = None
            if more:
                bits = np.frombuffer(blob, np.uint8, -(-n // 8), at)
                at += len(bits)
                counts = np.frombuffer(blob, "<u4", -(-n // BLOCK), at)
                at += 4 * len(counts)
            self.levels.append((chunks, bits, counts))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, counts: np.ndarray, i: int) -> int:
        """Set bits before bit ``i``."""
        block = min(i // BLOCK, len(counts) - 1)
        first, last = block * BLOCK // 8, i // 8
        found = int(counts[block]) + int(np.bitwise_count(bits[first:last]).sum())
        return found + (int(bits[last]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else found

    def __getitem__(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, counts in self.levels:
            value |= int(chunks[i]) << shift
            if bits is None or not int(bits[i // 8]) >> i % 8 & 1:
                break
            i, shift = self._rank(bits, counts, i), shift + 8
        return value

    def take(self, positions: np.ndarray) -> np.ndarray:
        """The ids at ``positions``: one step a level for all of them."""
        at = np.asarray(positions, np.int64)
        ids, on = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bits, counts) in enumerate(self.levels):
            ids[on] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            if bits is None or not len(on):
                break
            more = (bits[at // 8] >> (at % 8).astype(np.uint8) & 1).astype(bool)
            on, at = on[more], at[more]
            # set bits before each: the count of its block, whole bytes since, and bits of its own byte
            first, last = at // BLOCK * (BLOCK // 8), at // 8
            within = np.arange(BLOCK // 8)
            spread = first[:, None] + within
            whole = np.bitwise_count(bits[np.minimum(spread, len(bits) - 1)]) * (spread < last[:, None])
            own = np.bitwise_count(bits[last] & ((1 << (at % 8)) - 1).astype(np.uint8))
            at = counts[at // BLOCK].astype(np.int64) + whole.sum(1, dtype=np.int64) + own
        return ids

    def range(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """The ids from ``start`` to before ``end``."""
        chunks, bits, counts = self.levels[level]
        ids = chunks[start:end].astype(np.uint32)
        if bits is not None and end > start:
            more = np.unpackbits(bits[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :][: end - start].astype(bool)
            low = self._rank(bits, counts, start)
            ids[more] |= self.range(low, low + int(more.sum()), level + 1) << 8
        return ids


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Segments of all documents in ascending id order (``CODES_SCHEMA``); write the result before reading from it.

    Documents are dealt to ranges of ids and each range is encoded by one task
    in order; ``part`` numbers the ranges, ``part_offset`` the ids before a
    segment in its range.  The texts are shuffled once.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys = ["doc_id", "tie"]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = memory(tokenizer), TaskContext.get().partitionId()
        seq = offset = size = 0
        ids: list[int | None] = []
        ends: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            codes = encode(np.concatenate(held))
            row = {"part": part, "seq": seq, "part_offset": offset, "n_tokens": size, "doc_ids": ids, "doc_ends": ends, "codes": codes}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW_CODES)

        for batch in small(batches):
            for own, found, stops in encoded(words, batch.column("doc_id"), batch.column("text"), end_id):
                begin = 0
                for owner, stop in zip(own, stops.tolist(), strict=True):
                    held.append(found[begin:stop])
                    size += stop - begin
                    begin = stop
                    ids.append(owner)
                    ends.append(size)
                    if size >= SEGMENT_TOKENS or len(ids) >= SEGMENT_DOCS:
                        yield flush()
                        seq, offset, size = seq + 1, offset + size, 0
                        ids, ends, held = [], [], []
        if ids:
            yield flush()

    return dealt.sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(write, CODES_SCHEMA)


_ARROW_CODES = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("part_offset", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("codes", pa.binary()),
])
_ARROW_TEXTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def with_starts(codes: DataFrame) -> DataFrame:
    """Code table with ``start``: the ids of all documents before a segment.

    The counts that are summed over all ranges have one row a range, so their
    number is that of the tasks that wrote the table.
    """
    parts = codes.groupBy("part").agg(F.max(F.col("part_offset") + F.col("n_tokens")).alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    return codes.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("part_offset")).drop("part_start")


def read_documents(codes: DataFrame) -> DataFrame:
    """Ids of each document read from a code table: ``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                segment = Segment(one.column("codes")[0].as_py())
                base, ids = one.column("start")[0].as_py(), one.column("doc_ids")[0].as_py()
                ends = one.column("doc_ends")[0].as_py()
                begins = [0, *ends[:-1]]
                for at in range(0, len(ids), 2000):
                    part = slice(at, at + 2000)
                    found = [segment.range(a, b).astype("<u4").tobytes() for a, b in zip(begins[part], ends[part], strict=True)]
                    columns = [ids[part], [base + a for a in begins[part]], [len(x) // 4 for x in found], found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_TEXTS, strict=True)], schema=_ARROW_TEXTS)

    return with_starts(codes).select("doc_ids", "doc_ends", "codes", "start").mapInArrow(read, TEXTS_SCHEMA)


def read_tokens(codes: DataFrame, positions: DataFrame, position: str = "position") -> DataFrame:
    """The id at each global position of ``positions``: ``position, token``, by random access; positions outside give no row.

    Positions meet their segments in a join on buckets of ``SEGMENT_TOKENS``
    positions; a segment stands in each bucket that it overlaps.  A position
    asked for many times is looked up once, so that what meets at a segment is
    no more than the segment has ids.
    """
    spans = with_starts(codes).withColumn("end", F.col("start") + F.col("n_tokens"))
    bucket = lambda c: F.floor(c / F.lit(SEGMENT_TOKENS))
    spans = spans.filter("n_tokens > 0").withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end") - 1))))
    asked = positions.select(F.col(position).cast("long").alias("position")).groupBy("position").agg(F.count(F.lit(1)).alias("times"))
    met = asked.withColumn("bucket", bucket(F.col("position"))).join(spans.select("bucket", "part", "seq", "start", "end"), "bucket").filter("position >= start and position < end")
    lists = met.groupBy("part", "seq", "start").agg(F.collect_list(F.struct("position", "times")).alias("asked"))
    wanted = codes.join(lists, ["part", "seq"]).select("codes", "start", "asked")

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                segment, start = Segment(one.column("codes")[0].as_py()), one.column("start")[0].as_py()
                rows = one.column("asked")[0].values
                places, times = (rows.field(k).to_numpy() for k in ("position", "times"))
                for at in range(0, len(places), 5000):
                    part = slice(at, at + 5000)
                    columns = [places[part], segment.take(places[part] - start).astype(np.int64), times[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["position", "token", "times"])

    found = wanted.mapInArrow(pick, "position long, token long, times long")
    return found.select("position", "token", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")

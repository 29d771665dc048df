"""Packing of documents into training windows by multiway differencing.

Documents are tokenized, closed by an end id and cut: full windows stand alone,
and what is left of a document is cut into pieces of at most ``piece`` ids.
Pieces gather into batches of about ``windows`` windows, and each batch is
partitioned by the Karmarkar-Karp method: the two partial partitions with the
largest imbalance are merged, the fullest window of one with the emptiest of
the other, until one partition is left.  If a window exceeds its capacity the
batch gets one window more and is partitioned again.

Batches form inside a task from the documents it reads, so nothing is shuffled
and a task holds one batch at a time; each task ends with one batch that may be
smaller.  Window numbers carry the task's partition number; a task that is run
again reads the same rows in the same order and gives the same windows.

Edge cases: a null text is empty (its only id is the end id); a null document
id is carried; repeated rows are packed each; an empty table gives no windows.
Columns other than the two named are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import small
from lodestone.llm.tokens import encoded, memory

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([*((name, pa.int64()) for name in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def differencing(lengths: list[int], windows: int) -> tuple[list[int], list[list[int]]]:
    """Near-equal partition of ``lengths`` (none of them 0) into ``windows``: sums in ascending order, and the positions in each.

    A partial partition lists its filled windows only, by ascending sum; the
    others are empty.  As the fullest windows of one meet the emptiest of the
    other, no sums are added up while the filled windows of both find room.
    """
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    tie = len(lengths)
    first = lambda pair: pair[0]
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free_a, free_b = windows - len(b), windows - len(a)  # lowest windows that stay alone: of a where b is empty, and the reverse
        if free_a >= len(a):
            merged = a + b
        else:
            a_low, b_low = len(a) - max(free_a, 0), len(b) - max(free_b, 0)
            merged = [(x + y, (p, q)) for (x, p), (y, q) in zip(a[:a_low], reversed(b[:b_low]), strict=True)] + a[a_low:] + b[b_low:]
        merged.sort(key=first)
        spread = merged[-1][0] - (merged[0][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, tie, merged))
        tie += 1
    filled = heap[0][2] if heap else []
    sums, members = [0] * (windows - len(filled)), [[] for _ in range(windows - len(filled))]
    for total, tree in filled:
        found, stack = [], [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            else:
                found.append(node)
        sums.append(total)
        members.append(sorted(found))
    return sums, members


def fill_windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``lengths`` (each at most ``capacity``) in as few near-equal windows as the method finds."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        sums, members = differencing(lengths, windows)
        if sums[-1] <= capacity:
            return [x for x in members if x]
        windows += 1


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, piece: int = 128, windows: int = 64, slack: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces and their places: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian unsigned 32-bit integers; a batch closes when it
    has ``windows * (capacity - slack)`` ids, less a piece.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    enough = windows * (capacity - slack) - piece
    wide = 4 * capacity

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = memory(tokenizer)
        number, held, size, out = TaskContext.get().partitionId() << 40, [], 0, []

        def place() -> None:
            nonlocal number
            for members in fill_windows([len(x[3]) // 4 for x in held], capacity):
                offset = 0
                for i in members:
                    own, start, total, ids = held[i]
                    out.append((own, start, len(ids) // 4, total, number, offset, ids))
                    offset += len(ids) // 4
                number += 1

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
            out.clear()
            return made

        for batch in small(batches):
            for owners, found, ends in encoded(words, batch.column("doc_id"), batch.column("text"), end_id):
                raw, begin = found.tobytes(), 0
                for owner, stop in zip(owners, ends.tolist(), strict=True):
                    ids, begin = raw[4 * begin : 4 * stop], stop
                    total, full = len(ids) // 4, len(ids) // wide * wide
                    for start in range(0, full, wide):
                        out.append((owner, start // 4, capacity, total, number, 0, ids[start : start + wide]))
                        number += 1
                    for start in range(full, len(ids), 4 * piece):
                        held.append((owner, start // 4, total, ids[start : start + 4 * piece]))
                        size += len(held[-1][3]) // 4
                        if size >= enough:
                            place()
                            held.clear()
                            size = 0
                if len(out) >= 5000:
                    yield emit()
        if held:
            place()
        if out:
            yield emit()

    return rows.mapInArrow(pack, SCHEMA)


def assemble(pieces: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """Windows for a trainer: ``sequence_id, ids array<int>`` of ``capacity`` ids, the last ones ``pad_id``."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        parts = table.sort_by("offset").column("ids").to_pylist()
        ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
        full = np.full(capacity, pad_id, np.int32)
        full[: len(ids)] = ids
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([full], pa.list_(pa.int32()))})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<int>")

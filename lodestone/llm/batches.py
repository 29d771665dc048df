"""Arrow batches cut small, so that few texts exist as Python strings at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def small(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches; what Arrow holds ready for the next one goes back to the system, as workers share an executor's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
            pa.default_memory_pool().release_unused()

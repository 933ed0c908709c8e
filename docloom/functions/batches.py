"""Arrow batches in parts of a bounded size, so that a Python worker holds little at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of one column that are handled at once.
PART_BYTES = 4 << 20


def portions(batch: pa.RecordBatch, column: str, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of one column, and one row at least."""
    rows = batch.num_rows
    step = max(1, min(rows, rows * size // max(batch.column(column).nbytes, 1)))
    for start in range(0, rows, step):
        yield batch.slice(start, step)

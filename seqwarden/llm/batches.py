"""Arrow batches cut by bytes, so that very long texts do not meet in one step of a task, and workers that keep no memory between tasks."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTES_AT_ONCE = 4 << 20


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that hold at most ``most`` bytes of that column, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for ``mapInArrow``; when a task is over, the memory that Arrow has no use for goes back to the system.

    Python workers live on for the tasks of later steps, and Arrow's pool otherwise keeps the most that any task took.
    """

    @functools.wraps(run)
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return released

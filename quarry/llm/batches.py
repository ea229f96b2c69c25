"""Arrow batches of bounded size, shared by the operators that run Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text held as Python objects at a time.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut each batch where ``column`` passes ``limit`` bytes (a longer row stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            yield batch.slice(lo, hi - lo)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]

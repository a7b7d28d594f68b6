"""Arrow batches of long rows, a slice at a time: what a task holds depends on the slice, not on the rows of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Entries (bytes, tokens) that one step works on, but for a longer row.
SLICE = 1 << 18


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a column of binaries (as bytes) or of arrays of numbers; a null row is empty."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        offs = np.asarray(column.offsets, np.int64)
        values = column.values.slice(offs[0], offs[-1] - offs[0]) if len(column) else column.values[:0]
        values, offs = np.asarray(values), offs - offs[0]
        if column.null_count:  # a null row may have entries below it
            lens = np.where(np.asarray(column.is_valid()), np.diff(offs), 0)
            values = values[np.repeat(lens > 0, np.diff(offs))]
            offs = np.concatenate([[0], np.cumsum(lens)])
        return values, offs
    column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return values, offs - offs[0]


def slices(offs: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` entries (``SLICE``) and rows together, or one row."""
    ends = offs + np.arange(len(offs))
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + (SLICE if most is None else most), side="right")) - 1)
        yield i, j
        i = j

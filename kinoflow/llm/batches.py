"""Small helpers for work inside Arrow batches with bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) of a binary column of at most ``most`` bytes, or a single row."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(column).to_numpy(zero_copy_only=False), dtype=float))
    start, held = 0, 0.0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0.0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def lists(values: np.ndarray, counts: list[int] | np.ndarray) -> pa.Array:
    """A list array from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column; null lists are empty. Values must not hold nulls."""
    lengths = np.nan_to_num(np.asarray(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), dtype=float))
    return column.flatten().to_numpy(zero_copy_only=False), lengths.astype(np.int64)

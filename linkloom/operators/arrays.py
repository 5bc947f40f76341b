"""numpy and Arrow helpers for operators that work on array blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def chunks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The stream of batches in tables of about ``rows`` rows; the last may be smaller, an empty stream gives none."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def mixed(keys: np.ndarray) -> np.ndarray:
    """A well spread unsigned 64-bit value of each integer key, the same in every process."""
    x = keys.astype(np.int64).view(np.uint64).copy()
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    c = table.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def list_array(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Lists of consecutive slices of ``values``; ``starts`` has one more element than there are lists."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))

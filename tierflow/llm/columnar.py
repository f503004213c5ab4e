"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes that one step of a task works on; only a single longer text exceeds it.
CHUNK_BYTES = 16 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets between them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    if data is None:
        return np.zeros(0, np.uint8), offsets - first
    return np.frombuffer(data, np.uint8)[first:last], offsets - first


def chunks(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` text bytes, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(
            pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64
        )
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + limit, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Return unused memory to the system.

    A worker outlives its task, and what it keeps for later counts against the
    executor while the next stage runs.
    """
    pa.default_memory_pool().release_unused()
    # Only the GNU library keeps freed memory until it is told, and has this call.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freed(result: pa.Table) -> pa.Table:
    """``result`` of a step, after what the step used went back."""
    give_back()
    return result


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit integer mix; works on unsigned arrays, returns a new one."""
    out = values ^ (values >> np.uint64(32))
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the named columns, cast to the schema."""
    arrays = []
    for field in schema:
        values = columns[field.name]
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        if not isinstance(values, pa.Array):
            values = pa.array(values)
        arrays.append(values.cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)

"""Rows of numbers in bulk: NumPy arrays dealt to buckets as one binary row for each bucket that gets any.

A shuffle then moves a few large rows in place of millions of small ones, and each bucket is worked on with arrays. The cost of a
deal is that of sorting its rows, however many buckets there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCHEMA = "bucket int, kind int, payload binary"
ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def packed(key: np.ndarray, arrays: list[np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """The distinct keys, and for each one binary with its rows; rows keep their order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    rows = np.empty(len(key), dtype=[(f"f{i}", a.dtype) for i, a in enumerate(arrays)])
    for i, a in enumerate(arrays):
        rows[f"f{i}"] = a[order]
    offsets = (np.append(starts, len(key)) * rows.itemsize).astype(np.int32)
    return key[starts], pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def deal(key: np.ndarray, n_buckets: int, arrays: list[np.ndarray], kind: int = 0) -> Iterator[pa.RecordBatch]:
    """One row a bucket that gets any."""
    if len(key):
        buckets, payload = packed((key.view(np.uint64) % np.uint64(n_buckets)).astype(np.int32), arrays)
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(np.full(len(buckets), kind, np.int32)), payload], schema=ARROW)


def gather(table: pa.Table, dtypes: list[str], kind: int = 0) -> list[np.ndarray]:
    """The arrays of all of a bucket's rows of one kind."""
    payload = table.column("payload").filter(pc.equal(table.column("kind"), kind)).combine_chunks()
    return unpacked(payload, dtypes)


def unpacked(payload: pa.Array, dtypes: list[str]) -> list[np.ndarray]:
    layout = np.dtype([(f"f{i}", d) for i, d in enumerate(dtypes)])
    payload = pa.concat_arrays(payload.chunks) if isinstance(payload, pa.ChunkedArray) and payload.num_chunks else payload
    if not len(payload):
        return [np.empty(0, dtype=d) for d in dtypes]
    offsets = np.frombuffer(payload.buffers()[1], np.int32, len(payload) + 1, 4 * payload.offset)
    raw = payload.buffers()[2]
    rows = np.frombuffer(raw, layout, (int(offsets[-1]) - int(offsets[0])) // layout.itemsize, int(offsets[0])) if raw is not None else np.empty(0, layout)
    return [np.ascontiguousarray(rows[f]) for f in layout.names]

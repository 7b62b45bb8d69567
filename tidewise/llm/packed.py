"""Shuffling many small integer records as packed blocks.

A task gathers (hash, value columns) records in numpy, sorts them by hash
bucket and hands Spark one row per bucket: the bucket number and the packed
arrays. Spark shuffles the rows by bucket; the receiving side unpacks them.
The number of buckets follows the number of records, so that a bucket holds
about ``BUCKET_RECORDS`` whatever the size of the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BUCKET_RECORDS = 1 << 16
FLUSH_RECORDS = 1 << 19
MAX_BITS = 30


def bucket_bits(records: int) -> int:
    """log2 of the number of buckets for so many records in all."""
    return int(min(MAX_BITS, max(4, np.ceil(np.log2(max(1, records) / BUCKET_RECORDS)))))


def split_hash(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, the next 32 bits) of well-mixed 64-bit hashes. With buckets of
    constant size, two different hashes of a bucket share the 32 bits with a
    chance that does not grow with the input."""
    return ((hashes >> U(64 - bits)).astype(np.int32),
            ((hashes >> U(32 - bits)) & U(0xFFFFFFFF)).astype(np.uint32))


def pack(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket: bucket, and each column's bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) \
        if len(bucket) else np.zeros(0, np.int64)
    arrays = [pa.array(bucket[first], pa.int32())]
    for c in columns:
        c = np.ascontiguousarray(c[order])
        raw = c.view(np.uint8) if len(c) else np.zeros(0, np.uint8)
        width = c.dtype.itemsize
        offsets = np.append(first, len(bucket)) * width
        arrays.append(pa.Array.from_buffers(
            pa.binary(), len(first),
            [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())]))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket"] + [f"c{i}" for i in range(len(columns))])


def packed_schema(n_columns: int) -> str:
    return "bucket int, " + ", ".join(f"c{i} binary" for i in range(n_columns))


def unpack(column, dtype) -> np.ndarray:
    """All records of a packed column (any iterable of blocks)."""
    blocks = [np.frombuffer(x.as_py() if hasattr(x, "as_py") else x, dtype) for x in column]
    return np.concatenate(blocks) if blocks else np.zeros(0, dtype)

"""Shuffles of columns packed in binary rows: one row for each (batch, partition) instead of one for each value.

A packed row holds the values of one partition as little-endian arrays, so a shuffle of many small numbers costs as many
bytes as they have and no work per value in the JVM.  A value that a large share of rows have adds its 16 or so bytes a
row to one partition, not a row each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import pieces_of


def _murmur3(x: np.ndarray) -> np.ndarray:
    """Spark's hash() of an int column (Murmur3, 32 bits, seed 42)."""
    x = x.astype(np.uint32)

    def rotl(v: np.ndarray, r: int) -> np.ndarray:
        return (v << np.uint32(r)) | (v >> np.uint32(32 - r))

    h = np.uint32(42) ^ (rotl(x * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
    h = rotl(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).astype(np.int32)


@lru_cache(maxsize=16)
def keys_of(n: int) -> np.ndarray:
    """For each of n partitions, an int that repartition(n, column) deals to it: the deal is even, not random."""
    out = np.full(n, -1, np.int64)
    start = 0
    while (out < 0).any():
        x = np.arange(start, start + 8 * n)
        at = _murmur3(x).astype(np.int64) % n
        first, index = np.unique(at, return_index=True)
        fresh = out[first] < 0
        out[first[fresh]] = x[index[fresh]]
        start += 8 * n
    return out.astype(np.int32)


def packed(n: int, part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch | None:
    """Rows (key, c0, c1, ...) of the values dealt to partitions part (0 to n - 1)."""
    if not len(part):
        return None
    order = np.argsort(part.astype(np.uint16) if n <= 65536 else part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(n + 1))
    used = np.flatnonzero(np.diff(edges))
    arrays = [pa.array(keys_of(n)[used])]
    for c in columns:
        data, size = c[order], c.dtype.itemsize
        offsets = np.append(edges[used], edges[-1]).astype(np.int64) * size
        arrays.append(pa.Array.from_buffers(pa.large_binary(), len(used), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["key", *(f"c{i}" for i in range(len(columns)))])


def schema_of(n_columns: int) -> str:
    return ", ".join(["key int", *(f"c{i} binary" for i in range(n_columns))])


def deal(df: DataFrame, n: int, dtypes: list[type], emit: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, list[np.ndarray]]]]) -> DataFrame:
    """Packed rows of what emit gives for each batch of df (partition numbers and columns), dealt to n partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, 2048):
            for part, columns in emit(b):
                out = packed(n, part, [c.astype(t, copy=False) for c, t in zip(columns, dtypes, strict=True)])
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema_of(len(dtypes))).repartition(n, F.col("key"))


def unpack(batches: Iterator[pa.RecordBatch], dtypes: list[type]) -> list[np.ndarray]:
    """All values of a partition, column by column."""
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for b in batches:
        for i, t in enumerate(dtypes):
            parts[i] += [np.frombuffer(x, t) for x in b.column(i + 1).to_pylist()]
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, dtypes, strict=True)]


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: the values cut into rows of `counts` values."""
    size = values.dtype.itemsize
    offsets = np.append(0, np.cumsum(counts)).astype(np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())

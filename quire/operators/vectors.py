"""Feature vectors: normalisation, cosine similarity, best match against a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def best_matches(base: DataFrame, queries: DataFrame, k: int, least: float = -1.0, block_rows: int = 4096) -> DataFrame:
    """query_id, vec_id, similarity: the k most similar rows of base for each query (ties by id), similarity at least
    `least`; a row isn't compared with the query of its own id.

    queries(query_id, vector) is a stated set of any size, taken in blocks of about block_rows: a block is a matrix that each
    task multiplies its rows with, batch by batch, and of which it keeps the k best of each query and nothing else.  Null
    vectors are left out; a zero vector has similarity 0."""
    blocks = max(1, -(-queries.count() // block_rows))
    parts = None
    for b in range(blocks):
        rows = queries.where((F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) & F.col("vector").isNotNull()).select("query_id", "vector").collect()
        if rows:
            met = base.where("vector is not null").select("vec_id", "vector").mapInArrow(_best_of(rows, k, least), "query_id long, vec_id long, similarity double")
            parts = met if parts is None else parts.unionAll(met)
    if parts is None:
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")  # k rows a task
    return parts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def _best_of(rows: list, k: int, least: float):
    ids = np.array([r["query_id"] for r in rows], np.int64)
    q = _unit(np.array([r["vector"] for r in rows], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_s, top_v = np.full((0, len(ids)), -np.inf), np.zeros((0, len(ids)), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = part.column(0).to_numpy().astype(np.int64)
                v = _unit(np.array(part.column(1).to_pylist(), np.float64))
                s = (v[:, None, :] * q[None, :, :]).sum(axis=2) if len(v) * q.size < 1 << 24 else v @ q.T
                s = np.where((own[:, None] == ids[None, :]) | (s < least), -np.inf, s)
                s, w = np.concatenate([top_s, s]), np.concatenate([top_v, np.broadcast_to(own[:, None], s.shape)])
                order = np.lexsort((w, -s), axis=0)[:k]
                top_s, top_v = np.take_along_axis(s, order, axis=0), np.take_along_axis(w, order, axis=0)
        good = top_s > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids, good.shape)[good]), pa.array(top_v[good]), pa.array(top_s[good])], ["query_id", "vec_id", "similarity"])

    return run


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)

"""A clustered index of vectors: cells around centroids, probed by shuffle.

Centroids are fitted on the driver on a bounded sample (`sample` rows, those with the least hash of their id); every row is
then assigned to its nearest centroid and kept in a table by cell.  A query goes to its nearest `probes` cells.  Rows and
queries of a cell meet in groups of bounded size: a cell with more rows than `group_rows`, or asked by more queries, is cut
on both sides, so neither a cell that holds a third of all vectors nor a popular one is gathered in one task.

The exact answer takes one more round: a cell can be left out for a query only if no vector in it can be nearer than the
k-th found so far, by the angle to the centroid less the cell's largest angle.  Only the cells' figures reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.vectors import _unit, best_matches

MATCH = "query_id long, vec_id long, similarity double"


@dataclass(frozen=True)
class CellParams:
    sample: int = 20_000
    most_cells: int = 4_096
    rows_per_cell: int = 200  # at least, of the table as far as the sample allows
    rounds: int = 8
    probes: int = 8
    group_rows: int = 20_000
    seed: int = 5


@dataclass(frozen=True)
class CellIndex:
    rows: DataFrame  # cell, vec_id, vector
    centroids: np.ndarray
    sizes: dict[int, int]
    radii: np.ndarray  # the largest angle of a cell's vectors to its centroid
    params: CellParams


def fit(base: DataFrame, params: CellParams = CellParams()) -> np.ndarray:
    """Unit centroids by spherical k-means over the sample."""
    p = params
    held = base.where("vector is not null")
    n = held.count()
    rows = held.select("vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.sample).collect()
    if not rows:
        return np.zeros((0, 0))
    v = _unit(np.array([r["vector"] for r in rows], np.float64))
    k = max(1, min(p.most_cells, len(v) // 8, int(n / p.rows_per_cell) or 1))
    rng = np.random.default_rng(p.seed)
    c = v[rng.choice(len(v), k, replace=False)]
    for _ in range(p.rounds):
        of = (v @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, v)
        empty = ~np.isin(np.arange(k), of)
        sums[empty] = v[rng.choice(len(v), int(empty.sum()))] if empty.any() else 0
        c = _unit(sums)
    return c


def _assigned(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """rows(id, vector) with a row for each of the `probes` nearest cells: cell, angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                s = _unit(np.array(part.column(1).to_pylist(), np.float64)) @ centroids.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(len(s)), near.shape[1]))
                angle = np.arccos(np.clip(np.take_along_axis(s, near, axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), *(part.column(i).take(row) for i in range(2)), pa.array(angle.ravel())], ["cell", *b.schema.names, "angle"])

    kind = rows.schema[1].dataType.simpleString()
    return rows.mapInArrow(run, f"cell int, {rows.columns[0]} long, vector {kind}, angle double")


def build(base: DataFrame, path: str, params: CellParams = CellParams()) -> CellIndex:
    """The index of base(vec_id, vector), its rows written to the path.  Null vectors are left out; zero vectors lie somewhere."""
    centroids = fit(base, params)
    held = base.where("vector is not null").select("vec_id", "vector")
    if not len(centroids):
        return CellIndex(held.withColumn("cell", F.lit(0)), centroids, {}, np.zeros(0), params)
    _assigned(held, centroids, 1).write.parquet(path)
    rows = base.sparkSession.read.parquet(path)
    figures = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()  # a row a cell
    radii = np.full(len(centroids), -np.inf)
    for f in figures:
        radii[f["cell"]] = f["r"]
    return CellIndex(rows.select("cell", "vec_id", "vector"), centroids, {f["cell"]: f["n"] for f in figures}, radii, params)


def _meet(index: CellIndex, asked: DataFrame, k: int, least: float) -> DataFrame:
    """The k best of each (query, group) for asked(cell, query_id, vector)."""
    most = index.params.group_rows
    asked_sizes = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell

    def cuts(sizes: dict[int, int]) -> F.Column:
        many = {c: -(-n // most) for c, n in sizes.items() if n > most}
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("cell")), F.lit(1)) if many else F.lit(1)

    def dealt(rows: DataFrame, key: str, own: str, other: str, own_cuts: F.Column, other_cuts: F.Column) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64(key), own_cuts).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), other_cuts - 1)))

    a, b = cuts(index.sizes), cuts(asked_sizes)
    base = dealt(index.rows, "vec_id", "part", "asked", a, b)
    queries = dealt(asked, "query_id", "asked", "part", b, a)
    on = ["cell", "part", "asked"]
    return base.groupBy(*on).cogroup(queries.groupBy(*on)).applyInArrow(_compare(k, least), MATCH)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length, none of them null, without a Python object for each number."""
    return np.concatenate([np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64) for c in vectors.chunks]).reshape(len(vectors), -1)


def _compare(k: int, least: float):  # noqa: ANN202
    def run(base: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if base.num_rows and queries.num_rows:
            v = _unit(_matrix(base.column("vector")))
            ids = base.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            v, ids = v[order], ids[order]
            step = max(1, (1 << 21) // len(v))
            for at in range(0, queries.num_rows, step):
                part = queries.slice(at, step)
                own = part.column("query_id").to_numpy()
                s = np.round(_unit(_matrix(part.column("vector"))) @ v.T, 12)
                s[(own[:, None] == ids[None, :]) | (s < least)] = -np.inf
                reach = np.partition(s, len(v) - k, axis=1)[:, len(v) - k, None] if len(v) > k else -np.inf
                row, col = np.nonzero((s >= reach) & (s > -np.inf))  # by id in a row
                order = np.lexsort((col, -s[row, col], row))
                row, col = row[order], col[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k  # equals by id
                row, col = row[best], col[best]
                out_q.append(own[row])
                out_v.append(ids[col])
                out_s.append(s[row, col])
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"query_id": cat(out_q, np.int64), "vec_id": cat(out_v, np.int64), "similarity": cat(out_s, np.float64)})

    return run


def _top(rows: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")  # k rows a group that was asked
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def search(index: CellIndex, queries: DataFrame, k: int, least: float = -1.0, exact: bool = False, scratch: str | None = None) -> DataFrame:
    """query_id, vec_id, similarity: the k most similar rows for each of queries(query_id, vector), equals by id; a row isn't
    compared with the query of its own id.  Null vectors ask nothing; a zero vector has similarity 0.

    Approximate by default.  `exact` visits all cells that may hold a better row; `scratch` is a new shared folder for what the
    first round has found."""
    p, spark = index.params, queries.sparkSession
    held = queries.where("vector is not null").select("query_id", "vector")
    if not len(index.centroids):
        return spark.createDataFrame([], MATCH)
    probes = min(p.probes, len(index.centroids))
    first = _top(_meet(index, _assigned(held, index.centroids, probes).drop("angle"), k, least), k)
    if not exact or probes == len(index.centroids):
        return first
    if scratch is None:
        raise ValueError("an exact search needs a scratch folder")
    first.write.parquet(scratch)
    first = spark.read.parquet(scratch)
    floor = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("floor"))
    known = held.join(floor, "query_id", "left").select("query_id", "vector", F.when(F.col("n") >= k, F.col("floor")).otherwise(F.lit(least)).alias("floor"))
    centroids, radii = index.centroids, index.radii

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, (1 << 16) // len(centroids))  # every cell may be asked for
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                s = _unit(np.array(part.column(1).to_pylist(), np.float64)) @ centroids.T
                seen = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                nearest = np.cos(np.maximum(0.0, np.arccos(np.clip(s, -1, 1)) - radii[None, :])) + 1e-7  # arccos is coarse near 1
                may = (nearest >= part.column(2).to_numpy()[:, None]) & np.isfinite(radii)[None, :]
                np.put_along_axis(may, seen, False, axis=1)
                row, cell = np.nonzero(may)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(part.column(i).take(pa.array(row)) for i in range(2))], ["cell", "query_id", "vector"])

    kind = held.schema["vector"].dataType.simpleString()
    more = known.mapInArrow(run, f"cell int, query_id long, vector {kind}")
    return _top(first.unionByName(_meet(index, more, k, least)), k)


def in_blocks(base: DataFrame, queries: DataFrame, k: int, least: float = -1.0, block_rows: int = 20_000) -> DataFrame:
    """query_id, vec_id, similarity: the exact k best by comparing all pairs, a block of rows with a block of queries at a time.

    Both sides are dealt by a hash of their id; a group is one block of each, so a task's memory doesn't grow with the table.
    Work grows with rows times queries, and what is shuffled with that over block_rows."""
    a, b = base.where("vector is not null").select("vec_id", "vector"), queries.where("vector is not null").select("query_id", "vector")
    parts, asked = (max(1, -(-x.count() // block_rows)) for x in (a, b))

    def dealt(rows: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left, right = dealt(a, "vec_id", "part", parts, "asked", asked), dealt(b, "query_id", "asked", asked, "part", parts)
    return _top(left.groupBy("part", "asked").cogroup(right.groupBy("part", "asked")).applyInArrow(_compare(k, least), MATCH), k)


def nearest(base: DataFrame, queries: DataFrame, k: int, few: int = 4_096) -> DataFrame:
    """The exact k best: up to `few` queries are one matrix that every task multiplies its rows with; more of them meet the rows
    in blocks.  Cells aren't asked here: vectors of many dimensions leave hardly a cell out, and a query would be sent to each."""
    if queries.limit(few + 1).count() <= few:
        return best_matches(base, queries, k, block_rows=few)
    return in_blocks(base, queries, k)

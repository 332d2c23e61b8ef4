"""A keyed table in hash buckets: a batch of changes rewrites the buckets that it touches and no other.

A bucket is a folder of Parquet files; a version is a manifest that names each bucket's folder and the last batch that each
source has applied.  A batch writes new folders for its buckets and then the next manifest, which must not exist yet: that is
the commit, so a reader sees all of a batch or nothing, a failed batch leaves only folders that no manifest names, and of two
writers of one version the later fails.  A batch whose number its source has applied already changes nothing, so a stream may
send it again.

The manifest has a line for each bucket; the driver sees it and the numbers of the touched buckets, nothing of the rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = Callable[[DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer has made the version."""


@dataclass(frozen=True)
class KeyedTable:
    path: str
    key: str
    buckets: int
    schema: str  # as JSON
    version: int = 0
    folders: tuple[tuple[int, str], ...] = ()  # bucket, folder below data
    applied: tuple[tuple[str, int], ...] = ()  # source, its last batch


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifest(path: str, version: int) -> str:
    return f"{path}/log/{version:012d}.json"


def _commit(spark: SparkSession, t: KeyedTable) -> KeyedTable:
    p, fs = _fs(spark, _manifest(t.path, t.version))
    text = json.dumps({"key": t.key, "buckets": t.buckets, "schema": t.schema, "folders": t.folders, "applied": t.applied})
    try:
        out = fs.create(p, False)  # fails if the file is there
    except Py4JJavaError as e:
        raise Conflict(f"version {t.version} of {t.path} is there already") from e
    out.write(text.encode())
    out.close()
    return t


def create(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> KeyedTable:
    """An empty table of version 0."""
    return _commit(spark, KeyedTable(path.rstrip("/"), key, buckets, schema.json()))


def load(spark: SparkSession, path: str, version: int | None = None) -> KeyedTable:
    """The newest version, or a given one."""
    path = path.rstrip("/")
    if version is None:
        p, fs = _fs(spark, f"{path}/log")
        version = max(int(s.getPath().getName()[:12]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))
    raw = spark.read.option("wholetext", True).text(_manifest(path, version)).first()[0]
    m = json.loads(raw)
    return KeyedTable(path, m["key"], m["buckets"], m["schema"], version, tuple((b, f) for b, f in m["folders"]), tuple((s, n) for s, n in m["applied"]))


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, _manifest(path.rstrip("/"), 0))
    return fs.exists(p)


def _read(spark: SparkSession, t: KeyedTable, folders: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(t.schema))
    return spark.read.schema(schema).parquet(*[f"{t.path}/data/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, t: KeyedTable, keys: list | None = None) -> DataFrame:
    """All rows, or those of the keys, for which only their buckets are read."""
    if keys is None:
        return _read(spark, t, [f for _, f in t.folders])
    kind = T.StructType.fromJson(json.loads(t.schema))[t.key].dataType
    asked = spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(t.key, kind)]))
    held = {r["b"] for r in asked.select(_bucket(t).alias("b")).distinct().collect()}
    return _read(spark, t, [f for b, f in t.folders if b in held]).where(F.col(t.key).isin(*keys))


def _bucket(t: KeyedTable) -> F.Column:
    return F.pmod(F.xxhash64(t.key), F.lit(t.buckets)).cast("int")


def apply(spark: SparkSession, t: KeyedTable, changes: DataFrame, merge: Merge, source: str, batch: int) -> KeyedTable:
    """The table after a batch: merge(rows of the touched buckets and the changes) gives one row a key.

    merge() should aggregate by key, so that a key with very many changes is combined before it is shuffled.  Rows with a null
    key have a bucket like others.  A batch that the source has applied, or one without changes, leaves the data as it is."""
    done = dict(t.applied)
    if batch <= done.get(source, -1):
        return t
    columns = T.StructType.fromJson(json.loads(t.schema)).names
    dealt = changes.select(*columns, _bucket(t).alias("__bucket"))
    touched = {r["__bucket"] for r in dealt.select("__bucket").distinct().collect()}
    after = replace(t, version=t.version + 1, applied=tuple(sorted((done | {source: batch}).items())))
    if touched:
        current = _read(spark, t, [f for b, f in t.folders if b in touched])
        merged = merge(current.select(*columns).unionByName(changes.select(*columns))).select(*columns)
        folder = f"v{after.version:012d}-{uuid.uuid4().hex[:8]}"
        merged.withColumn("bucket", _bucket(t)).repartition("bucket").sortWithinPartitions("bucket", t.key).write.partitionBy("bucket").parquet(f"{t.path}/data/{folder}")
        # a merge may drop a bucket's last key; its folder is then absent and so no part of the version
        _, fs = _fs(spark, t.path)
        there = {s.getPath().getName() for s in fs.listStatus(_fs(spark, f"{t.path}/data/{folder}")[0])}
        kept = {b: f for b, f in t.folders if b not in touched} | {b: f"{folder}/bucket={b}" for b in touched if f"bucket={b}" in there}
        after = replace(after, folders=tuple(sorted(kept.items())))
    return _commit(spark, after)


def vacuum(spark: SparkSession, t: KeyedTable, keep: int = 2) -> None:
    """Remove the manifests before the newest `keep` and the folders that no manifest left names."""
    log, fs = _fs(spark, f"{t.path}/log")
    versions = sorted(int(s.getPath().getName()[:12]) for s in fs.listStatus(log) if s.getPath().getName().endswith(".json"))
    named = {f for v in versions[-keep:] for _, f in load(spark, t.path, v).folders}
    for v in versions[:-keep]:
        fs.delete(_fs(spark, _manifest(t.path, v))[0], False)
    data = _fs(spark, f"{t.path}/data")[0]
    for folder in fs.listStatus(data) if fs.exists(data) else []:
        name = folder.getPath().getName()
        for part in fs.listStatus(folder.getPath()):
            if part.getPath().getName().startswith("bucket=") and f"{name}/{part.getPath().getName()}" not in named:
                fs.delete(part.getPath(), True)

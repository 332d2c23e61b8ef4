"""Helpers that several operators share: shared-folder tables, words, Arrow plumbing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words, as SQL / Java / RE2 pattern and as bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own only where that is unset (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    What a result reads lazily goes when the driver's Python ends; what is done with before goes by drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


_paths: dict[str, SparkSession] = {}


def drop(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_quire_path", None)
        if path in _paths:
            _remove(_paths.pop(path), path)


@atexit.register
def _remove_all() -> None:
    for path, spark in _paths.items():
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        if sc._jsc is not None and not sc._jsc.sc().isStopped():
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Py4JError:  # the session is gone; whoever owns the folder clears it
        pass


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished, unreferenced stages."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


PARTITION_BYTES = 128 << 20


def partitions(df: DataFrame) -> int:
    """Partitions of a packed shuffle of what df's texts give: the session's number, or more where the input is larger than
    PARTITION_BYTES (by the plan's own estimate, for a scan its files) for each, as Python holds one partition at a time.
    Where the plan has no estimate, as for rows from the driver, the session's number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(number, -(-size // PARTITION_BYTES)) if size < 1 << 50 else number


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores: dealt anew only where the scan has fewer splits than there are cores, as with a table of
    one row group; a table of any size beyond that is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pieces_of(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of few rows, so that only a few texts are Python objects at a time; what was freed goes back to the
    system after each batch, so that a worker's memory doesn't grow from stage to stage."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text as UTF-8; none for null. bytes.split() cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_H = xxhash.xxh3_64_intdigest
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_H, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * _M1
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words; with fewer words, the whole sequence as one; none for no word."""
    n = len(h)
    if not n:
        return h
    k = min(size, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out * _M2 + h[i : n - k + 1 + i])
    return out


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def without_ids(docs: DataFrame, gone: DataFrame, doc_id: str, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of docs whose id isn't in gone(id); rows without an id stay.

    The ids are written first, so their number is known: up to broadcast_rows they are broadcast (a few MB), else both
    sides are shuffled."""
    ids = materialise(gone.select(gone[gone.columns[0]].alias("__gone")).distinct(), "ids")
    side = F.broadcast(ids) if ids.limit(broadcast_rows + 1).count() <= broadcast_rows else ids
    return docs.join(side, docs[doc_id] == side["__gone"], "left_anti")

"""Session defaults shared by the entry module, the bench and the tests."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quire", cpus: str | int = 8, **extra: str) -> SparkSession:
    """A local session with the settings that the oracle comparison relies on (UTC, AQE)."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("QUIRE_DRIVER_MEMORY", "8g"),
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in extra.items()}
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per session, so that they need no installation or shared path."""
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quire-")) / "quire.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(str(target))
    sc._quire_shipped = True


def shared_base(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one of the session's own on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark.sparkContext, "_quire_base", None) or tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext._quire_base = at
    return at.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder below shared_base()."""
    return f"{shared_base(spark)}/quire-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written once to a new shared folder: for what is used more than once and costs more to compute than to read."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def input_state(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files of a table's folder (or of its one file), by the file system's listing."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    listed = at.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(at)
    return hashlib.sha256(repr(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in listed)).encode()).hexdigest()[:24]

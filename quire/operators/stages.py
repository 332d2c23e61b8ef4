"""A stage of the file pipeline as a batch with several outputs: what it accepts, what fails, and the audit of both.

A batch is judged in one scan of its input, and the judgement is written once; every output is a projection of it, written to a
folder of the batch.  The batch counts from the moment its marker exists, which is written last and only once: a batch that
failed half-way is written over by its next attempt, and one that counts is not run again."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import blank, file_key, size_category, smart_id
from quire.operators.indexdocs import suffix
from quire.session import exists

OUTPUTS = ("files", "queue", "events", "states")

#: The priorities there are, from critical to archive.
PRIORITIES = (1, 2, 3, 5, 7, 10)


def _batches(spark: SparkSession, root: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []


def output(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """An output's rows of all batches that count; None before the first."""
    parts = [f"{root}/{name}/batch={b}" for b in _batches(spark, root)]
    return spark.read.option("basePath", f"{root}/{name}").parquet(*parts) if parts else None


def file_type(ext: Column, name: Column, path: Column) -> Column:
    """The stated extension, else the name's, else the path's."""
    own = F.ltrim(F.lower(F.trim(F.coalesce(ext, F.lit("")))), F.lit("."))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(suffix(F.coalesce(name, F.lit(""))), F.lit("")), suffix(F.coalesce(path, F.lit(""))))


def stage_event(stage: str, status: Column, at: Column, worker: Column, department: Column, error_type: Column, error: Column, payload: Column) -> dict[str, Column]:
    """The audit row of a stage for a row with file_hash, file_id, file_name, file_path and extension.  The id's date is the
    event's, so an event written again has the same id."""
    key = file_key(F.col("file_hash"), F.col("file_id"), F.col("file_path"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return {
        "event_time": at, "file_key": key, "smart_id": smart_id(department, at, key, "19700101"), "file_name": text("file_name"), "file_path": text("file_path"), "stage": F.lit(stage), "status": status, "worker_id": worker,
        "file_type": file_type(F.col("extension"), F.col("file_name"), F.col("file_path")), "error_type": error_type, "error_message": error, "payload_json": payload,
    }


def stage_state(event: dict[str, Column], current: Column) -> dict[str, Column]:
    """The state row that goes with a stage's event."""
    same = {k: event[k] for k in ("file_key", "smart_id", "file_name", "file_type", "file_path", "worker_id")}
    return same | {"current_status": current, "processed_on": event["event_time"], "file_size": F.coalesce(F.col("file_size"), F.lit(0)).cast("long"), "updated_at": event["event_time"], "source_stage": event["stage"]}


def _error() -> Column:
    return (
        F.when(blank(F.col("file_path")), "no file path").when(blank(F.col("file_hash")), "no file hash").when(F.col("file_size").isNull() | (F.col("file_size") < 0), "no file size")
        .when(F.col("priority").isNull() | ~F.col("priority").isin(*PRIORITIES), "unknown priority")
    )


def discover(spark: SparkSession, root: str, files: DataFrame, batch: int, worker: str, at: str) -> bool:
    """Run a batch of files(file_path, file_name, file_size, extension, file_hash, modified_time, created_time, priority); whether it
    ran, or had been run before.

    A file that lacks what it needs gives a failed event and state.  Of the others, those with a hash that an earlier batch
    has are left out, and of equal hashes in the batch the smallest path stays; it gives a row of files and of the queue, a
    completed event and a pending state.  Its number is a hash of its path and hash, so a retried batch numbers alike."""
    if exists(spark, f"{root}/commits/{batch}.json"):
        return False
    rows = files.withColumns({"error": _error(), "file_id": F.xxhash64("file_hash", "file_path").bitwiseAND(F.lit((1 << 63) - 1))})
    good = rows.where("error is null")
    first = good.groupBy("file_hash").agg(F.min("file_path").alias("file_path"))
    known = output(spark, root, "files")
    if known is not None:
        first = first.join(known.select("file_hash"), "file_hash", "left_anti")
    accepted = good.join(first, ["file_hash", "file_path"], "left_semi").dropDuplicates(["file_hash", "file_path"])
    accepted.unionByName(rows.where("error is not null")).write.mode("overwrite").parquet(f"{root}/judged/batch={batch}")
    judged = spark.read.schema(rows.schema).parquet(f"{root}/judged/batch={batch}")
    ok = F.col("error").isNull()
    category = size_category(F.col("file_size"))
    payload = F.when(ok, F.to_json(F.struct(category.alias("size_category"), "priority")))
    event = stage_event("discovery", F.when(ok, "completed").otherwise("failed"), F.lit(at), F.lit(worker), F.lit(""), F.when(~ok, "DISCOVERY_ERROR"), F.col("error"), payload)
    state = stage_state(event, F.when(ok, "pending").otherwise("failed"))
    taken = judged.where(ok)
    outputs = {
        "files": taken.select("file_id", "file_path", "file_name", "file_size", F.col("extension").alias("file_extension"), "file_hash", F.col("modified_time").alias("last_modified"), F.col("created_time").alias("created"), category.alias("size_category"), "priority", F.lit("pending").alias("status"), F.lit(at).alias("discovered_at")),
        "queue": taken.select("file_id", "file_path", "file_size", category.alias("size_category"), "priority", F.lit("pending").alias("status")),
        "events": judged.select(*[c.alias(k) for k, c in event.items()]),
        "states": judged.select(*[c.alias(k) for k, c in state.items()]),
    }
    for name in OUTPUTS:
        outputs[name].write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/commits/{batch}.json")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    out.write(json.dumps({"batch": batch, "worker": worker, "at": at}).encode())
    out.close()
    return True

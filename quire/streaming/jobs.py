"""Structured Streaming forms: status counts, windows with late data, micro-batch merges, stateful dedup and a breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators import keyedtable
from quire.session import is_folder, scratch


def event_stream(spark: SparkSession, folder: str, file: str = "events.parquet", per_trigger: int = 100) -> DataFrame:
    """A table (the event log) as a stream of its files, be it one file or a folder of them; the schema comes from the table."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return stream.parquet(f"{folder}/{file}") if is_folder(spark, f"{folder}/{file}") else stream.option("pathGlobFilter", file).parquet(folder)


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling event-time window; events later than the watermark are left out."""
    ts = events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    return ts.groupBy(F.window("event_time", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    ts = events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    return ts.groupBy(F.session_window("event_time", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def heartbeats(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))


def first_seen(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, so state is bounded."""
    return events.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late).dropDuplicatesWithinWatermark([key])


def breaker(events: DataFrame, limit: int = 5, open_seconds: int = 60) -> DataFrame:
    """worker, state: open after `limit` failures in a row; the first event `open_seconds` later finds it half-open and closes
    it by a success or opens it again by a failure.  Time is the events' own, so a replay gives the same states."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, opened = state.get if state.exists else (0, -1.0)
        for b in batches:
            for at, failed in b.sort_values("at")[["at", "failed"]].itertuples(index=False):
                half_open = opened >= 0 and at - opened >= open_seconds
                failures = failures + 1 if failed else 0
                if failed and (half_open or (opened < 0 and failures >= limit)):
                    opened = float(at)
                elif not failed and (half_open or opened < 0):
                    opened = -1.0
        state.update((failures, opened))
        yield pd.DataFrame({"worker": [key[0]], "state": ["open" if opened >= 0 else "closed"]})

    rows = events.select(F.col("user_id").alias("worker"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at") / 1e6, (F.col("event_type") == "error").alias("failed"))
    return rows.toDF("worker", "at", "failed").groupBy("worker").applyInPandasWithState(step, "worker long, state string", "failures int, opened double", "update", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is there now, through the streaming engine: each batch is written to the shared folder, and read back are the
    last one of a complete result, or all of an appended or updated one."""
    spark, at, written = df.sparkSession, scratch(df.sparkSession), []

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batch-{epoch}")
        written.append(f"{at}/batch-{epoch}")

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    paths = written[-1:] if mode == "complete" else written
    return spark.read.schema(df.schema).parquet(*paths) if paths else spark.createDataFrame([], df.schema)


def merge_batches(df: DataFrame, path: str, key: str, seq: str, checkpoint: str, buckets: int = 16):
    """A keyed last-wins table kept by micro-batches: each rewrites the buckets that it touches, once however often it is sent."""

    def latest(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (key, seq)]
        return rows.groupBy(key).agg(F.max(F.struct(seq, *rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in (seq, *rest)])

    return merge_stream(df, path, key, latest, checkpoint, buckets)


def merge_stream(df: DataFrame, path: str, key: str, merge: keyedtable.Merge, checkpoint: str, buckets: int = 16):
    """A keyed table (operators/keyedtable) kept by micro-batches; the stream's checkpoint names the source, its epochs the
    batches."""
    spark = df.sparkSession
    if not keyedtable.exists(spark, path):
        keyedtable.create(spark, path, df.schema, key, buckets)

    def run(batch: DataFrame, epoch: int) -> None:
        keyedtable.apply(batch.sparkSession, keyedtable.load(batch.sparkSession, path), batch, merge, checkpoint, epoch)

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

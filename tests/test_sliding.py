"""Sliding counts against plain counting; one key for all events is counted by many tasks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quire.operators.queues import sliding_count


def test_against_plain_counting(spark):
    r, start = random.Random(4), dt.datetime(1969, 12, 31, 23, 50)
    rows = [(i, r.choice([1, 1, 1, 2, None]), start + dt.timedelta(microseconds=r.choice([0, 250_000, 10**6]) * r.randrange(900)), r.random() < 0.5) for i in range(1500)]
    rows += [(1500, 1, None, True), (1501, 1, None, True), (1502, None, None, True)]
    df = spark.createDataFrame(rows, "id long, k int, ts timestamp, bad boolean")
    for seconds in (1, 60, 100_000):
        got = {x["id"]: x["n"] for x in sliding_count(df, "k", "ts", seconds, "n", F.col("bad")).collect()}
        span = dt.timedelta(seconds=seconds)
        want = {i: sum(b for _, k2, t2, b in rows if k2 == k and (t2 is None if t is None else t2 is not None and t - span <= t2 <= t)) for i, k, t, _ in rows}
        assert got == want


def test_one_key_uses_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 30).alias("ts"))
    out = sliding_count(df, "k", "ts", 60, "n")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [x["c"] for x in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and len(sizes) > 1 and max(sizes) < 20_000 * 2 / len(sizes)

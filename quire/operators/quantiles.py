"""Exact quantiles of a column of any size.

An approximate sketch brackets the value; only rows within the bracket are looked at further, as counts of distinct values in
ranges.  No task holds more than its range, and the driver sees a number a range."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantile(df: DataFrame, column: str, q: float, accuracy: int = 1_000) -> float | None:
    """The q-quantile, between its neighbours in proportion, as percentile() gives it; nulls are left out, None for no value."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    slack = 2.0 / accuracy
    facts = values.agg(F.count("*").alias("n"), F.percentile_approx("v", [max(0.0, q - slack), min(1.0, q + slack)], accuracy).alias("between"), F.min("v").alias("least"), F.max("v").alias("most")).first()
    n = facts["n"]
    if not n:
        return None
    at = (n - 1) * q
    lower, upper = math.floor(at), math.ceil(at)
    low, high = (facts["least"] if q - slack <= 0 else facts["between"][0]), (facts["most"] if q + slack >= 1 else facts["between"][1])
    inside = values.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("c"))
    below = values.where(F.col("v") < low).count()
    a, b = _value_at(inside, lower - below), _value_at(inside, upper - below)
    if a is None or b is None:  # the sketch missed by more than it promises
        inside, below = values.groupBy("v").agg(F.count("*").alias("c")), 0
        a, b = _value_at(inside, lower), _value_at(inside, upper)
    return a + (b - a) * (at - lower)


def _value_at(counts: DataFrame, rank: int) -> float | None:
    """The value of a rank, from 0, of counts(v, c) in order; None beyond them."""
    if rank < 0:
        return None
    ranged = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()).persist()
    try:
        before = 0
        for r in ranged.groupBy("part").agg(F.sum("c").alias("n"), F.min("v").alias("first")).orderBy("first").collect():  # a row a range
            if rank < before + r["n"]:
                running = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
                return ranged.where(F.col("part") == r["part"]).select("v", running.alias("upto")).where(F.col("upto") > rank - before).agg(F.min("v")).first()[0]
            before += r["n"]
        return None
    finally:
        ranged.unpersist()

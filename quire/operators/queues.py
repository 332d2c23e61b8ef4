"""Work queues as tables: claims, transitions, statistics, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "completed", "failed")


def claimable(queue: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """Pending items, and items claimed longer ago than the timeout."""
    return queue.where((F.col("status") == "pending") | ((F.col("status") == "processing") & (F.col("claimed_at") < now - F.expr(f"interval {stale_seconds} seconds"))))


def claim(queue: DataFrame, n: int, by: list[str], now: Column, stale_seconds: int = 300) -> DataFrame:
    """The next n items in order."""
    return claimable(queue, now, stale_seconds).orderBy(*by).limit(n)


def reset_stale(queue: DataFrame, now: Column, stale_seconds: int = 1800) -> DataFrame:
    """All items; stale claims are pending again."""
    stale = (F.col("status") == "processing") & (F.col("claimed_at") < now - F.expr(f"interval {stale_seconds} seconds"))
    return queue.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "claimed_at": F.when(~stale, F.col("claimed_at"))})


def route_failures(items: DataFrame, max_retries: int = 3) -> DataFrame:
    """All items with `route`: requeue for a transient error with retries left, else dead_letter."""
    again = F.col("transient") & (F.col("retry_count") < max_retries)
    return items.withColumns({"route": F.when(again, "requeue").otherwise("dead_letter"), "retry_count": F.col("retry_count") + again.cast("int")})


def status_pivot(queue: DataFrame, by: list[str], statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """Total and a count per status, one pass."""
    return queue.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def missing(files: DataFrame, *queues: DataFrame, key: str = "id") -> DataFrame:
    """Files that no queue holds."""
    ids = queues[0].select(key)
    for q in queues[1:]:
        ids = ids.unionByName(q.select(key))
    return files.join(ids.distinct(), key, "left_anti")


def sliding_count(events: DataFrame, key: str, ts: str, seconds: int, name: str, condition: Column | None = None) -> DataFrame:
    """Events of the same key in the last `seconds` seconds, the event included; equal times count together.

    Time is cut into slices as long as the window, so an event's window lies in its own slice and the one before.  Each event
    is dealt to both slices that need it, by (key, slice): no task sorts more of a key than two windows' length, and a key
    that has all events is counted by as many tasks as it has slices.  Rows of a key without a time count together."""
    n = seconds * 1_000_000
    at, part, value = F.unix_micros(F.col(ts).cast("timestamp")), F.col("__part"), F.when(F.lit(True) if condition is None else condition, 1).otherwise(0)
    slice_ = F.floor(at / F.lit(n)).cast("long")
    dealt = events.withColumns({"__at": at, "__n": value, "__here": slice_}).withColumn("__part", F.explode(F.when(slice_.isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(slice_, slice_ + 1))))
    w = Window.partitionBy(key, part).orderBy("__at").rangeBetween(-n, 0)
    counted = dealt.withColumn(name, F.sum("__n").over(w)).where(F.col("__here").eqNullSafe(part))
    return counted.drop("__at", "__n", "__here", "__part")


def eta(stats: DataFrame, remaining: str, seconds: str, workers: str, default: float) -> Column:
    return F.col(remaining) * F.coalesce(F.when(F.col(seconds) > 0, F.col(seconds)), F.lit(default)) / F.greatest(F.col(workers), F.lit(1))


def reconcile(expected: DataFrame, actual: DataFrame, dynamic: list[str]) -> DataFrame:
    """metric, expected, actual, ok: within max(5, 3 %) for dynamic metrics, else equal."""
    both = expected.join(actual, "metric", "full")
    gap = F.abs(F.coalesce("expected", F.lit(0)) - F.coalesce("actual", F.lit(0)))
    room = F.when(F.col("metric").isin(dynamic), F.greatest(F.lit(5), F.floor(F.coalesce("expected", F.lit(0)) * 0.03))).otherwise(0)
    return both.withColumn("ok", gap <= room)

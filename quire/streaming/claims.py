"""Claims of work that run out: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Claims(StatefulProcessor):
    """The open claims of a bucket of items: their ids and times, in milliseconds; a timer stands where the first of them runs out.

    An item's events are taken in order of time, of equal times in order of status (completed, failed, pending, processing).
    Every event gives a row; a claim without another event until its timeout gives the row that returns it, be it that the
    watermark passes its end or that a later event comes first, so the rows don't depend on how the stream is cut."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ids array<long>, at array<long>, due long")

    def _held(self) -> tuple[np.ndarray, np.ndarray, int | None]:
        ids, at, due = self.open.get() if self.open.exists() else ([], [], None)
        return np.array(ids, np.int64), np.array(at, np.float64), due

    def _hold(self, ids: np.ndarray, at: np.ndarray, timer: int | None) -> None:
        """Open claims from now on, and a timer for the first; `timer` is the one that stands."""
        due = int(at.min()) + self.timeout_ms if len(at) else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is None:
            self.open.clear()
            return
        if timer != due:
            self.handle.registerTimer(due)
        self.open.update((ids.tolist(), at.astype(np.int64).tolist(), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new = pd.concat([x[["id", "status", "at_ms"]] for x in rows], ignore_index=True)
        ids, at, timer = self._held()
        old = np.arange(len(ids) + len(new)) < len(ids)
        status = np.concatenate([np.full(len(ids), "processing", object), new["status"].to_numpy(object)])
        ids, at = np.concatenate([ids, new["id"].to_numpy(np.int64)]), np.concatenate([at, new["at_ms"].to_numpy(np.float64)])
        order = np.lexsort((np.unique(status.astype(str), return_inverse=True)[1], at, ~old, ids))  # the claim that was open comes first
        ids, at, status, old = ids[order], at[order], status[order], old[order]
        claim, followed = status == "processing", np.r_[ids[1:] == ids[:-1], False]
        gone = claim & followed & (at + self.timeout_ms <= np.r_[at[1:], np.nan])  # it ran out before, though no batch has passed its end
        yield _changes(key[0], ids[~old], status[~old], at[~old], False)
        if gone.any():
            yield _changes(key[0], ids[gone], "pending", at[gone] + self.timeout_ms, True)
        stays = claim & ~followed & ~np.isnan(at)
        if timer is not None or stays.any():
            self._hold(ids[stays], at[stays], timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        ids, at, _ = self._held()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        end = at + self.timeout_ms
        gone = (end <= fired) | (end < timerValues.getCurrentWatermarkInMs())
        self._hold(ids[~gone], at[~gone], None)  # a timer that has fired is gone
        if gone.any():
            yield _changes(key[0], ids[gone], "pending", end[gone], True)

    def close(self) -> None:
        pass


def _changes(bucket: int, ids: np.ndarray, status: np.ndarray | str, at: np.ndarray, expired: bool) -> pd.DataFrame:
    return pd.DataFrame({"id": pd.array(ids if bucket >= 0 else [None] * len(ids), "Int64"), "status": status, "at_ms": pd.array(at, "Int64"), "expired": expired})


def with_timers(spark: SparkSession) -> None:
    """Timers need the state store that keeps them."""
    spark.conf.set(PROVIDER, ROCKS)


def claim_changes(events: DataFrame, timeout_seconds: int, late: str = "0 seconds", buckets: int = 1024) -> DataFrame:
    """id, status, at_ms, expired of events(id, status, at): each event's row and each run-out claim's, as the watermark (the
    latest time less `late`) passes.  Events behind the watermark are left out, so state is bounded by the open claims.

    Items are kept by hash in `buckets`, since a call into the state costs far more than an item: each bucket takes a few calls
    a batch, and its events are sorted together.  Events without an id are a bucket and an item of their own."""
    with_timers(events.sparkSession)
    rows = events.select(F.col("id").cast("long").alias("id"), "status", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    dealt = rows.select(F.when(F.col("id").isNull(), -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(buckets))).cast("int").alias("bucket"), F.coalesce("id", F.lit(0)).alias("id"), "status", F.unix_millis("at").alias("at_ms"), "at")
    return dealt.groupBy("bucket").transformWithStateInPandas(Claims(timeout_seconds * 1000), "id long, status string, at_ms long, expired boolean", "update", "eventTime")


def current_status(changes: DataFrame) -> DataFrame:
    """id, status: the last change of each item; of equal times a return comes last."""
    return changes.groupBy("id").agg(F.max(F.struct("at_ms", "expired", "status")).alias("c")).select("id", "c.status")

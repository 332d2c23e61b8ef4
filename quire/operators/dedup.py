"""Exact deduplication by key: registries, survivors, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def registry(df: DataFrame, key: Column, seq: str, path: str | None = None) -> DataFrame:
    """One row per key: first_id, duplicates, and (if `path` is given) the later paths, comma-joined in order.

    The counts are partial sums; only the paths of a key are gathered."""
    keyed = df.withColumn("__key", key).where(F.col("__key") != "")
    aggs = [F.min(seq).alias("first_id"), (F.count("*") - 1).alias("duplicates")]
    if path:
        later = F.slice(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(path).alias("p")))), F.lit(2), F.count("*").cast("int"))
        aggs.append(F.array_join(F.transform(later, lambda x: x["p"].cast("string")), ",").alias("later_paths"))
    return keyed.groupBy(F.col("__key").alias("key")).agg(*aggs)


def mark_duplicates(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """All rows with `key`, `is_duplicate` and `primary_id` (first column of order); empty keys are never duplicates.

    A join with the minimum per key instead of a window: no key's rows are sorted in one task."""
    keyed = df.withColumn("key", key)
    first = keyed.where(F.col("key") != "").groupBy("key").agg(F.min(F.struct(*order)).alias("__first"))
    out = keyed.join(first, "key", "left")
    return out.withColumn("primary_id", F.coalesce(F.col(f"__first.{order[0]}"), F.col(order[0]))).withColumn("is_duplicate", F.coalesce(F.struct(*order) != F.col("__first"), F.lit(False))).drop("__first")


def survivors(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; of rows equal in the order any one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")  # ranks under a limit are cut before the shuffle


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key is neither in existing nor earlier in new."""
    return new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def unchanged(files: DataFrame, known: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Files that are known with the same path and size and a modification time within the tolerance."""
    k = known.select(F.col("path").alias("__p"), F.col("size").alias("__s"), F.col("mtime").alias("__m"))
    return files.join(k, (files["path"] == k["__p"]) & (files["size"] == k["__s"]) & (F.abs(files["mtime"] - k["__m"]) <= tolerance), "left_semi")

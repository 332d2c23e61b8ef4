"""Files within archives within archives: every file's root, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roots(parents: DataFrame, child: str = "child", parent: str = "parent", scratch: str = "") -> DataFrame:
    """child, root, depth of parents(child, parent): the outermost archive and how many levels lie above the child.

    In each round every file takes over what the file it points to points to, so the steps to the root halve: a chain of n
    levels takes log n joins of short rows.  The side that is looked up has one row a file; the members of an archive with very
    many of them are on the other side, which the adaptive join may split.  Of several parents of a child the smallest counts; null ids are left out.  A cycle has no root:
    its files, and those below them, have a null root and depth.  Each round is written below `scratch`, a new shared folder."""
    spark = parents.sparkSession
    known = parents.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(child).alias("child")).agg(F.min(parent).alias("up"))
    state = _written(known.withColumn("depth", F.lit(1).cast("long")).withColumn("done", F.lit(False)), f"{scratch}/round-0")
    for i in range(1, state.count().bit_length() + 1):  # a file that is still open then has more files above it than there are: a cycle
        if state.where("not done").isEmpty():
            break
        over = state.select(F.col("child").alias("up"), F.col("up").alias("over"), F.col("depth").alias("more"), F.col("done").alias("over_done"))
        step = state.where("not done").join(over, "up", "left")  # no row of its own: the file pointed to is a root
        moved = step.select("child", F.coalesce("over", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("over").isNull() | F.col("over_done")).alias("done"))
        was = state
        state = _written(was.where("done").unionByName(moved), f"{scratch}/round-{i}")
    return state.select(F.col("child").alias(child), F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

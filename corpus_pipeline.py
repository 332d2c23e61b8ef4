"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents.  run() applies them to documents, each stage's result written to the shared folder and read again.

ORACLE_SQL is None: the near-duplicate components, the passage removal and the packing are not expressible in SQL;
tests/llm/test_pipeline.py holds run() against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, jaccard_join, packing, quality, substring_dedup
from quire.llm.common import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no word, so they go; repeated rows are judged each; very long texts are judged whole; ties don't
    occur; an empty table stays empty; extra columns of any name stay."""
    return quality.quality_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays.

    Rows with null or empty text or without an id stay; repeated rows of the smallest id stay all; very long texts are
    compared whole; an empty table stays empty; extra columns of any name stay."""
    return jaccard_join.near_duplicates_removed(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier place has are cut out of the texts; no document goes. n_chars follows the text.

    Null and empty texts and rows without an id stay as they are; rows of one id are one document; of places in one document
    the first is the earlier; very long texts are searched whole; an empty table stays empty; an extra column n_removed is
    lost, others stay."""
    out = substring_dedup.dedup_spans(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Rows with null or empty text or without an id stay; rows of one id go together; very long texts are searched whole; an
    empty benchmark or table changes nothing; extra columns of any name stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences.

    Null and empty texts are one piece of the end id; repeated rows and null ids are packed each; very long texts are cut into
    as many pieces as they need; an empty table gives no piece; extra columns don't matter."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", passage_stage),
    ("benchmark leaks", benchmark_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Sources and sinks: the driver's tables as logical tables, file inventories, registries, keyed writes."""

from __future__ import annotations

import json
import os
import re
import tempfile
from fnmatch import translate
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("file_id", T.LongType()), T.StructField("file_path", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("file_size", T.LongType()),
    T.StructField("file_extension", T.StringType()), T.StructField("file_hash", T.StringType()), T.StructField("last_modified", T.DoubleType()), T.StructField("created", T.DoubleType()),
    T.StructField("size_category", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("discovered_at", T.DoubleType()),
])


#: Tables whose rows are texts, which take long each.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  Texts are dealt over all cores where their scan has fewer splits than there are cores, as a table of
    one row group has; a table of any size beyond that is left as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a work queue: id, status, priority, size, claimed_at."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "processing").otherwise("completed")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("worker"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("claimed_at"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an audit stream: id, ts, worker, stage, status, value, payload."""
    stage = F.when(F.col("event_type") == "view", "discovery").when(F.col("event_type") == "click", "extraction").when(F.col("event_type") == "signup", "indexing").when(F.col("event_type") == "purchase", "tagging").otherwise("ocr")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("worker"), stage.alias("stage"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), "value", F.col("props").alias("payload"))


def scan_files(spark: SparkSession, folder: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), priorities: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """A file inventory with SHA-256: extensions to take (all if none), globs on name or path to leave out, and ordered
    (substring, priority) rules of which the first that fits wins, else 5."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    rows = raw.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), ext.alias("extension"), F.sha2("content", 256).alias("file_hash"))
    if include:
        rows = rows.where(F.col("extension").isin(*[e.lower() for e in include]))
    for glob in exclude:
        p = translate(glob).replace("(?s:", "(?s:").removesuffix("\\z").removesuffix("\\Z")
        rows = rows.where(~(F.col("name").rlike(f"^{p}$") | F.col("path").rlike(f"^{p}$")))
    rank = F.lit(5)
    for part, value in reversed(priorities):
        rank = F.when(F.lower("path").contains(part.lower()), value).otherwise(rank)
    return rows.withColumn("priority", rank)


def embedded_documents(df: DataFrame, column: str) -> DataFrame:
    """An extractor's JSON list of maps: main (first map) and embedded (the rest with text, numbered, named by the first of
    resourceName, embedded:name, Content-Disposition, embedded_<i>)."""
    docs = F.from_json(F.col(column), "array<map<string,string>>")
    body = lambda d: F.trim(F.coalesce(F.element_at(d, "X-TIKA:content"), F.element_at(d, "content"), F.lit("")))

    def one(d, i):  # noqa: ANN001, ANN202
        given = F.regexp_extract(F.coalesce(F.element_at(d, "Content-Disposition"), F.lit("")), r'filename="?([^";]+)', 1)
        name = F.coalesce(F.element_at(d, "resourceName"), F.element_at(d, "embedded:name"), F.when(given != "", given), F.concat(F.lit("embedded_"), i.cast("string")))
        return F.struct(name.alias("name"), i.alias("index"), body(d).alias("content"))

    rest = F.transform(F.slice(docs, 2, F.greatest(F.size(docs) - 1, F.lit(0))), one)
    return df.withColumn("main_content", F.coalesce(body(F.element_at(docs, 1)), F.lit(""))).withColumn("embedded", F.filter(rest, lambda x: x["content"] != ""))


def registry(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, value) of a wide sheet of allowed values, null words left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.col(c).cast("string")).alias("value")) for c, f in fields.items()])).alias("p")
    rows = df.select(pairs).select("p.*")
    return rows.where(F.col("value").isNotNull() & ~F.lower("value").isin("", "nan", "none", "null", "n/a", "na", "-")).distinct()


def write_checkpoint(stats: dict, folder: str, name: str, keep: int = 10) -> str:
    """A statistics snapshot as JSON, written whole or not at all; only the newest `keep` stay."""
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w") as f:
        json.dump(stats, f)
    path = os.path.join(folder, f"checkpoint_{name}.json")
    os.replace(temporary, path)
    for old in sorted(Path(folder).glob("checkpoint_*.json"))[:-keep]:
        old.unlink()
    return path


def load_checkpoint(folder: str) -> dict | None:
    newest = sorted(p for p in Path(folder).glob("checkpoint_*.json") if re.search(r"checkpoint_.+\.json$", p.name))
    return json.loads(newest[-1].read_text()) if newest else None


def read_workbook(spark: SparkSession, path: str, anchors: tuple[str, ...] = (), look: int = 12) -> dict[str, DataFrame]:
    """Sheets of a small workbook (or one CSV) as string tables.  The header is the row of the first `look` with the most
    filled cells plus six for each anchor word; repeated names get numbers; empty rows go.  Read on the driver: workbooks
    are small by nature."""
    import pandas as pd

    if path.endswith(".csv"):
        raw = {Path(path).stem: pd.read_csv(path, header=None, dtype=str)}
    else:
        raw = pd.read_excel(path, sheet_name=None, header=None, dtype=str)
    out = {}
    for name, sheet in raw.items():
        sheet = sheet.dropna(how="all").reset_index(drop=True)
        if sheet.empty:
            continue
        points = [sum(1 for v in r if isinstance(v, str) and v.strip()) + 6 * sum(a in str(v).strip().lower() for v in r for a in anchors) for r in sheet.head(look).itertuples(index=False)]
        at = points.index(max(points))
        names: list[str] = []
        for i, v in enumerate(sheet.iloc[at]):
            n = str(v).strip() if isinstance(v, str) and v.strip() else f"column_{i}"
            names.append(n if n not in names else f"{n}_{sum(x == n or x.startswith(n + '_') for x in names) + 1}")
        body = sheet.iloc[at + 1 :].astype(object).where(sheet.iloc[at + 1 :].notna(), None)
        out[name] = spark.createDataFrame([tuple(r) for r in body.itertuples(index=False)], ", ".join(f"`{n}` string" for n in names))
    return out


def export_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """Each sheet as CSV with a header, written by the tasks."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")

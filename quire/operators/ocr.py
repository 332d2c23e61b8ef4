"""Recognition results as tables: attempts, pages, word confidences, visual snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_attempts(attempts: DataFrame, key: str) -> DataFrame:
    """key, attempt, text, confidence, valid: the first valid attempt of each item, else the most confident one with text."""
    ok = attempts.withColumn("has", F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).where("valid or has")
    rank = F.struct(F.col("valid").alias("v"), F.when(F.col("valid"), 0.0).otherwise(F.col("confidence")).alias("c"), (-F.col("attempt")).alias("a"))
    return ok.groupBy(key).agg(F.max_by(F.struct("attempt", "text", "confidence", "valid"), rank).alias("x")).select(key, "x.*")


def join_pages(pages: DataFrame, key: str, most: int = 50) -> DataFrame:
    """key, text, confidence: the pages up to `most` with a heading each, and the mean confidence of pages with text."""
    own = pages.where((F.col("page") <= most) & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))
    parts = F.array_sort(F.collect_list(F.struct("page", "text")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("--- Page "), p["page"].cast("string"), F.lit(" ---\n"), p["text"])), "\n\n")
    return own.groupBy(key).agg(text.alias("text"), F.avg("confidence").alias("confidence"))


def page_metrics(pages: DataFrame, key: str, means: list[str], sums: list[str]) -> DataFrame:
    return pages.groupBy(key).agg(F.count("*").alias("pages"), *[F.avg(c).alias(f"avg_{c}") for c in means], *[F.sum(c).alias(f"sum_{c}") for c in sums])


def coverage(words: DataFrame, key: str, least: float = 30.0) -> DataFrame:
    """Characters in confident words before and after processing, and the gain in percent."""
    n = lambda v: F.sum(F.when((F.col("variant") == v) & (F.col("confidence") > least), F.length(F.trim("word"))).otherwise(0))
    out = words.groupBy(key).agg(n("raw").alias("raw_chars"), n("processed").alias("processed_chars"))
    return out.withColumn("gain_percent", F.coalesce(F.try_divide((F.col("processed_chars") - F.col("raw_chars")) * 100.0, F.col("raw_chars")), F.lit(0.0)))


def snippet_policy(snippets: DataFrame, allowed: list[str], least: dict[str, float], top: dict[str, int]) -> DataFrame:
    """Snippets of allowed types with enough impact, the best few of each type on a page; a page that would lose everything
    keeps the best of each allowed type.  Ties go by id."""
    kind = F.lower(F.coalesce("type", F.lit("logo")))
    rows = snippets.withColumn("type", kind).where(F.col("type").isin(allowed) if allowed else F.lit(True))
    floor = F.coalesce(_pick(least), F.lit(0.0))
    rows = rows.withColumn("fits", F.col("impact") >= floor)
    w = Window.partitionBy("doc_id", "page", "type").orderBy(F.col("fits").desc(), F.col("impact").desc(), "snippet_id")
    ranked = rows.withColumn("rank", F.row_number().over(w)).withColumn("any", F.max("fits").over(Window.partitionBy("doc_id", "page")))
    keep = F.when(F.col("any"), F.col("fits") & (F.col("rank") <= F.coalesce(_pick(top), F.lit(1 << 30)))).otherwise(F.col("rank") == 1)
    return ranked.where(keep).select(*snippets.columns)


def _pick(table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("type")) if table else F.lit(None)


def is_artefact(kind: Column, impact: Column, box: Column, width: Column, height: Column) -> Column:
    """Signatures that are dust, lines or specks."""
    g = lambda i: F.get(box, F.lit(i))
    x1, y1 = F.greatest(F.least(g(0), width - 1), F.lit(0)), F.greatest(F.least(g(1), height - 1), F.lit(0))
    w, h = F.greatest(F.least(g(2), width) - x1, F.lit(1)), F.greatest(F.least(g(3), height) - y1, F.lit(1))
    line = (h / height < 0.002) | (w / width > 0.95) | (w / h > 40)
    return (kind == "signature") & ((impact <= 0.03) | line | (h < 4) | (w < 4) | (w * h < 16))


def deficit_category(kind: Column, red: Column, blue: Column, y: Column, height: Column, confidence: Column) -> Column:
    """Category by ink ratios, place on the page and recognition confidence."""
    by_place = F.when(y > height * 0.4, "signature").otherwise("handwritten")
    return (
        F.when(red > 0.01, "stamp").when((blue > 0.005) & (blue < 0.40), by_place).when(kind == "stamp", "stamp").when(kind == "signature", by_place)
        .when(kind.isin("text_anomaly", "faded_text"), F.when(confidence >= 70, "text_anomaly").when(confidence < 30, "faded_text").otherwise(kind)).otherwise(kind)
    )

"""Human review accounting: page-weighted accuracy, approval, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEUTRAL = ("logo", "stamp")


def accepted_impact(reviews: DataFrame) -> DataFrame:
    """Sum of accepted impacts per page; logos and stamps give nothing."""
    return reviews.where((F.col("status") == "accepted") & ~F.col("snippet_type").isin(*NEUTRAL)).groupBy("doc_id", "page").agg(F.sum("impact").alias("accepted"))


def document_accuracy(pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """doc_id, accuracy: content-weighted mean of min(100, base + accepted); a plain mean of min(100, base) if no page
    has weight.  Reviews are summed per page first and joined once."""
    p = pages.join(accepted_impact(reviews), ["doc_id", "page"], "left")
    w = F.col("weight")
    got = F.least(F.lit(100.0), F.col("base") + F.coalesce("accepted", F.lit(0.0)))
    return p.groupBy("doc_id").agg(F.when(F.sum(w) > 0, F.sum(got * w) / F.sum(w)).otherwise(F.avg(F.least(F.lit(100.0), F.col("base")))).alias("accuracy"))


def approval(reviews: DataFrame) -> DataFrame:
    """Counts by status, pending impact and the approval status of each document."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = reviews.groupBy("doc_id").agg(n("pending").alias("pending"), n("accepted").alias("accepted"), n("rejected").alias("rejected"), F.count("*").alias("total"), F.sum(F.when(F.col("status") == "pending", F.col("impact")).otherwise(0.0)).alias("pending_impact"))
    return out.withColumn("approval_status", F.when(F.col("pending") > 0, "Pending Review").when(F.col("accepted") > 0, "Approved").otherwise("Full Baseline"))


def feedback_boost(feedback: DataFrame) -> DataFrame:
    """field, value, n, boost = min(0.20, 0.02 n) of non-blank corrections."""
    out = feedback.where(F.trim(F.coalesce("value", F.lit(""))) != "").groupBy("field", "value").agg(F.count("*").alias("n"))
    return out.withColumn("boost", F.least(F.lit(0.20), F.col("n") * 0.02))


def current_reviews(log: DataFrame) -> DataFrame:
    """The last action of each review; a revert leaves it pending."""
    last = log.groupBy("review_id").agg(F.max(F.struct("seq", "action")).alias("x"))
    return last.select("review_id", F.when(F.col("x.action") == "revert", "pending").otherwise(F.col("x.action")).alias("status"))


def cancelled_actions(log: DataFrame) -> DataFrame:
    """The log with `is_cancelled`: actions that a later revert of the same review undoes; reverts themselves stand."""
    last = log.where("action = 'revert'").groupBy("review_id").agg(F.max("seq").alias("__r"))
    out = log.join(last, "review_id", "left")
    return out.withColumn("is_cancelled", F.coalesce((F.col("seq") < F.col("__r")) & (F.col("action") != "revert"), F.lit(False))).drop("__r")


def auto_tag_siblings(reviews: DataFrame, similarity: DataFrame, least: float = 0.90) -> DataFrame:
    """Pending siblings (signature, stamp, logo) of accepted snippets of the same document with enough similarity.

    similarity(a, b, s) holds snippet pairs; each pending snippet takes the most similar accepted one."""
    kinds = F.col("snippet_type").isin("signature", "stamp", "logo")
    done = reviews.where((F.col("status") == "accepted") & kinds).select(F.col("review_id").alias("a"), F.col("doc_id").alias("da"), F.col("snippet_type").alias("label"))
    todo = reviews.where((F.col("status") == "pending") & kinds).select(F.col("review_id").alias("b"), F.col("doc_id").alias("db"))
    near = similarity.where(F.col("s") >= least).join(done, "a").join(todo, "b").where("da = db")
    return near.groupBy("b").agg(F.max_by("label", F.struct("s", (-F.col("a")).alias("a"))).alias("label")).withColumnRenamed("b", "review_id")

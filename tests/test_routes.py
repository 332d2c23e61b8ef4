"""Search routes, small rules and Bloom filters on small inputs."""

from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.operators import bloom, routes


def _docs(spark):
    return spark.createDataFrame(
        [(1, "pay the bill", None, ["Ann Lee"], "a\\b\\c.pdf", "c.pdf", "Invoice", False, {"k": "zinc"}), (2, "", "pay later", [], "a/b/d.txt", "d.txt", None, True, {}), (3, None, None, None, None, None, "invoice", None, None)],
        "id int, main_content string, ocr_content string, key_names array<string>, file_path string, file_name string, category string, is_embedded boolean, extended_metadata map<string,string>",
    )


def _ids(df):
    return {r.id: r.score for r in df.select("id", "score").collect()}


def test_slash_modes(spark):
    docs = _docs(spark)
    assert _ids(routes.strict_slash(docs, "person", "ann lee")) == {1: 10.0}
    assert _ids(routes.strict_slash(docs, "tag", "INVOICE")) == {1: 10.0, 3: 10.0}
    assert _ids(routes.strict_slash(docs, "department", "x")) == {}
    assert _ids(routes.slash(docs, "tag", "zinc")) == {1: 10.0}


def test_terms_with_synonyms_and_fields_together(spark):
    docs = _docs(spark)
    boosts = {"main_content": 2.0, "ocr_content": 1.0, "metadata.x": 9.0}
    assert _ids(routes.accurate(docs, "pay invoice", boosts)) == {1: 4.0, 2: 1.0}
    assert _ids(routes.accurate(docs, "pay bill zinc", boosts)) == {1: 5.5}
    assert _ids(routes.accurate(docs, "pay the", boosts, {"category": ["Invoice"]})) == {1: 8.0}
    assert _ids(routes.accurate(docs, "!!", boosts)) == {}


def test_paths_allow_one_word_between(spark):
    assert _ids(routes.path(_docs(spark), "a/c.pdf", {"file_path": 1.0, "main_content": 5.0})) == {1: 8.0 + 2.0 + 1.0}


def test_fragments(spark):
    row = spark.createDataFrame([("xx and yy and The", None)], "a string, b string").select(routes.fragments(F.col("a"), ["and", "the"], 9, 1).alias("f"), routes.fragments(F.col("b"), ["and"], 9, 2).alias("g"), routes.fragments(F.col("a"), ["a"], 9, 2).alias("h")).first()
    assert (row.f, row.g, row.h) == (["<mark>and</mark> <mark>The</mark>"], [], [])


def test_rules_with_nulls(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(
        R.text_like(none, none, F.lit(None).cast("double")).alias("text"), R.sparse_noise(none, F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0)).alias("noise"), R.tsv_confidence(none).alias("tsv"), R.reviewer_role(none).alias("role"),
        R.memory_thresholds(F.lit(8.0), F.lit(4.0), F.lit(2.0)).alias("memory"), R.joined_value(F.array(F.lit("a"), none)).alias("joined"), R.embedded_pdf(F.array(F.struct(none.alias("name"), none.alias("content"))), "x").alias("pdf"),
    ).first()
    assert (row.text, row.noise, row.tsv, row.role, tuple(row.memory), row.joined, row.pdf) == (False, False, 0.0, "Reviewer", (8.0, 9.0), "a", None)


def test_bloom_has_no_false_negative(spark, tmp_path):
    m, k = bloom.shape(2000, 0.01)
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom.build(keys, "key", m, k).write.parquet(str(tmp_path / "bloom"))
    kept = spark.read.parquet(str(tmp_path / "bloom"))
    assert bloom.members(keys, "key", kept, m, k).where("not maybe").count() == 0
    other = spark.range(2000, 6000).select(F.concat(F.lit("k"), "id").alias("key"))
    assert bloom.members(other, "key", kept, m, k).where("maybe").count() < 4000 * 0.02
    assert bloom.members(keys, "key", kept.limit(0), m, k).where("maybe").count() == 0

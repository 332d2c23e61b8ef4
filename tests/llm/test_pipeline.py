"""The pipeline against a brute-force version of its stages."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import quality, substring_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 6)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(4, 12))).capitalize() + "."
    text = lambda n: " ".join(sentence() for _ in range(n))
    passage, items = text(8), [(j, text(4)) for j in range(3)]
    rows = [text(r.randint(9, 20)) for _ in range(25)]
    rows += [rows[0], rows[1].replace(rows[1].split()[5], "changed", 1), rows[2] + " tail", text(1), "junk " * 400, None, ""]
    rows += [text(9) + " " + passage + " " + text(9) for _ in range(4)] + [text(9) + " " + items[j][1] + " " + text(8) for j in (0, 1)]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], items


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    p = quality.QualityParams()
    kept = [(i, t) for i, t, *_ in rows if quality.verdicts(quality._figures(__import__("pyarrow").array([t]), p), p)[1][0]]
    classes = brute.components(kept)
    kept = [(i, t) for i, t in kept if classes[i][1] == i]
    cut = brute.without_spans(kept, substring_dedup.SpanParams())
    left = {i: " ".join(w) for i, (w, _) in cut.items()}
    leaked = {i for i, _ in brute.leaks(list(left.items()), items)}
    want = set(left) - leaked
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    assert {r["doc_id"]: " ".join(r["text"].split()) for r in out.collect()} == {i: left[i] for i in want}
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == want and len(leaked) == 2 and sum(n for _, n in cut.values()) > 100


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

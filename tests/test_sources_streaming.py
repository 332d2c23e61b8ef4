"""Sources, sinks and streams."""

import json

from pyspark.sql import functions as F

from quire.operators import keyedtable
from quire.sources import tables
from quire.streaming import jobs


def test_scan_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/One.TXT").write_text("x")
    (tmp_path / "a/two.pdf").write_text("y")
    (tmp_path / "skip.txt").write_text("z")
    got = {r["name"]: r for r in tables.scan_files(spark, str(tmp_path), include=(".txt",), exclude=("skip*",), priorities=(("/a/", 1),)).collect()}
    assert set(got) == {"One.TXT"} and got["One.TXT"]["priority"] == 1 and got["One.TXT"]["extension"] == ".txt"


def test_embedded_documents(spark):
    doc = json.dumps([{"X-TIKA:content": " main "}, {"content": "in", "resourceName": "r"}, {"content": " "}, {"content": "late"}])
    r = tables.embedded_documents(spark.createDataFrame([(doc,), (None,), ("broken",)], "j string"), "j").collect()
    assert r[0]["main_content"] == "main" and [(e["name"], e["content"]) for e in r[0]["embedded"]] == [("r", "in"), ("embedded_2", "late")]
    assert r[1]["main_content"] == "" and r[2]["main_content"] == ""


def test_checkpoints(tmp_path):
    for i in range(4):
        tables.write_checkpoint({"n": i}, str(tmp_path), f"2024010{i}", keep=2)
    assert tables.load_checkpoint(str(tmp_path)) == {"n": 3} and len(list(tmp_path.glob("checkpoint_*.json"))) == 2


def test_session_windows_equal_batch(spark, sf_dir):
    batch = jobs.session_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert batch.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_merge_batches(spark, sf_dir, tmp_path):
    jobs.merge_batches(jobs.event_stream(spark, sf_dir), str(tmp_path / "t"), "user_id", "event_id", str(tmp_path / "c")).awaitTermination()
    got = keyedtable.read(spark, keyedtable.load(spark, str(tmp_path / "t")))
    want = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert got.select("user_id", "event_id").exceptAll(want).isEmpty() and got.count() == want.count()


def test_breaker_opens(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:0{i}", 7, "error", 1.0, "{}") for i in range(6)] + [(9, "2024-01-01 00:00:01", 8, "view", 1.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events.parquet"))
    out = jobs.run_once(jobs.breaker(s), "update")
    assert {r["worker"]: r["state"] for r in out.collect()} == {7: "open", 8: "closed"}


def test_first_seen(spark, sf_dir):
    out = jobs.run_once(jobs.first_seen(jobs.event_stream(spark, sf_dir), "event_id"), "append")
    assert out.count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").distinct().count()


def test_workbook_header_promotion(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text("title,,\n,,\nName,Department,Name\na,x,1\n,,\nb,y,2\n")
    sheets = tables.read_workbook(spark, str(tmp_path / "sheet.csv"), anchors=("name", "department"))
    assert sheets["sheet"].columns == ["Name", "Department", "Name_2"] and sheets["sheet"].count() == 2
    tables.export_sheets(sheets, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/sheet")).count() == 2


def test_siblings_take_the_most_similar_label(spark):
    from quire.operators import review

    reviews = spark.createDataFrame([(1, 1, "logo", "accepted"), (2, 1, "stamp", "accepted"), (3, 1, "logo", "pending"), (4, 2, "logo", "pending"), (5, 1, "text", "pending")], "review_id long, doc_id long, snippet_type string, status string")
    similarity = spark.createDataFrame([(1, 3, 0.91), (2, 3, 0.95), (1, 4, 0.99), (1, 5, 0.99), (2, 3, 0.2)], "a long, b long, s double")
    assert [tuple(r) for r in review.auto_tag_siblings(reviews, similarity).collect()] == [(3, "stamp")]

"""Run modes, completions, back-fills and archives on small inputs."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import routes, runs


def _archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return out.getvalue()


def test_archive_members(spark, monkeypatch):
    good = _archive([("a/", ""), ("a/One.TXT", "x"), ("two.exe", "y"), ("b\\three.pdf", "z" * 100_000), (".txt", "hidden"), ("a/One.TXT", "x")])
    rows = spark.createDataFrame([("p.zip", bytearray(good), "h1"), ("q.zip", bytearray(good[:80]), "h2"), ("none", None, "h3"), ("plain", bytearray(b"text"), None)], "path string, content binary, file_hash string")
    got = runs.archive_members(rows.withColumn("extra", F.lit(1))).collect()
    assert [(r.parent_hash, r.file_name, r.file_extension, r.file_size) for r in got] == [("h1", "One.TXT", "txt", 1), ("h1", "three.pdf", "pdf", 100_000), ("h1", "One.TXT", "txt", 1)]
    assert got[1].file_hash == hashlib.sha256(b"z" * 100_000).hexdigest() and got[0].file_path == "p.zip!/a/One.TXT"
    assert runs.archive_members(rows.where("false")).count() == 0


def test_archive_limits(monkeypatch):
    content = _archive([("a.txt", "x" * 50), ("big.txt", "x" * 200), ("b.txt", "x" * 60), ("c.txt", "x")])
    monkeypatch.setattr(runs, "MOST_MEMBER", 100)
    monkeypatch.setattr(runs, "MOST_MEMBERS", 100)
    assert [m[2] for m in runs._members("p", content, "h")] == ["a.txt"]  # big is skipped, b ends the walk
    content = bytearray(content)
    content[40] ^= 255  # the first member's bytes no longer have their checksum
    assert list(runs._members("p", bytes(content), "h")) == []


def test_folders_of_a_run(spark):
    folders = spark.createDataFrame([("a", 1.9), ("b", 2.0), ("c", 3.0)], "folder string, mtime double")
    seen = spark.createDataFrame([("a", 1.1), ("b", 1.0)], "folder string, mtime double")
    names = lambda mode: sorted(r.folder for r in runs.folders_to_scan(folders, seen, mode).collect())
    assert names("full") == ["a", "b", "c"] and names("resume") == names("incremental") == ["b", "c"]
    with pytest.raises(ValueError):
        runs.folders_to_scan(folders, seen, "other")


def test_completions_count_the_first(spark):
    done = spark.createDataFrame([(1, "h", 10, 5, -3, 2, None), (2, "h", 20, 9, 7, 7, True), (3, None, 0, 1, 4, 1, True), (3, " ", 8, 2, 9, 9, False)], "id long, hash string, size long, at long, extract_ms long, index_ms long, is_duplicate boolean")
    got = {r.hash: r.asDict() for r in runs.completions(done).collect()}
    assert got["h"] == {"hash": "h", "id": 2, "size": 20, "at": 9, "extract_ms": 0, "index_ms": 2, "is_duplicate": False}
    assert got["3"]["size"] == 8 and got["3"]["extract_ms"] == 4
    assert runs.completion_counters(done).collect()[0].asDict() == {"completed": 2, "extract_ms": 4, "index_ms": 3, "duplicates": 1, "files": 3, "bytes": 30}
    assert runs.completions(done.where("false")).count() == 0 and runs.completion_counters(done.where("false")).collect()[0].completed == 0


def test_sources_and_single_rows(spark):
    assert runs.may_replace(None, "config") and runs.may_replace("ui", "cli") and runs.may_replace("api", "api")
    assert not runs.may_replace("cli", "ui") and not runs.may_replace(None, "file") and runs.may_replace("cli", "ui", force=True)
    docs, rows = spark.range(2), spark.createDataFrame([("x",)], "v string")
    assert [r.metadata.v for r in runs.only_row(docs, rows).collect()] == ["x", "x"]
    for other in (rows.where("false"), rows.union(rows)):
        assert [r.metadata for r in runs.only_row(docs, other).collect()] == [None, None]


def test_find_document(spark):
    docs = spark.createDataFrame([("a", 1), (None, 2)], "doc_id string, n int")
    assert runs.find_document(docs, "doc_id", "a").n == 1
    with pytest.raises(KeyError):
        runs.find_document(docs, "doc_id", "b")


def test_waiting_updates_are_cut(spark):
    pending = spark.createDataFrame([("a", "x" * 60_000, 1.0), ("b", "x" * 60_000, 1.0), ("", "y", 1.0), (None, "y", 1.0), ("b", None, None)], "doc_id string, ocr_content string, ocr_confidence double")
    sent, waiting = runs.flush_updates(pending, spark.createDataFrame([("a",), ("a",)], "doc_id string"))
    assert [len(r.ocr_content) for r in sent.collect()] == [60_000]
    assert sorted(len(r.ocr_content or "") for r in waiting.collect()) == [0, 50_000]


def test_router_on_odd_queries(spark):
    docs = spark.createDataFrame([(1, "pay the bill", "a/b.txt", "b.txt"), (2, None, None, None)], "id long, main_content string, file_path string, file_name string")
    find = lambda q, **more: [r.id for r in routes.find(docs, q, {"main_content": 1.0, "file_path": 1.0}, **more).collect()]
    assert find("pay bill") == [1] and find('"the bill"') == [1] and find("a/b.txt") == [1] and find("the bill", exact=True) == [1]
    assert find("") == find("!") == find('""') == find("12") == []
    assert find("pay", page=2) == [] and find("pay", filters={"id": [2]}) == []

"""Keyed tables, claims with timers, stage batches, lineage, quantiles, vectors and phrases against plain versions."""

import math
import random
import statistics
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import automaton
from quire.operators import keyedtable, lineage, metadata, quantiles, stages, tagging, vectorindex, vectors
from quire.operators.vectorindex import CellParams
from quire.streaming import claims, jobs


def latest(rows):
    return rows.groupBy("k").agg(F.max(F.struct("s", "v")).alias("r")).select("k", "r.s", "r.v")


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k long, s long, v string")
    t = keyedtable.create(spark, str(tmp_path / "t"), make([]).schema, "k", 8)
    t = keyedtable.apply(spark, t, make([(i, 1, "a") for i in range(100)] + [(None, 1, "null")]), latest, "s", 0)
    assert len(t.folders) == 8
    before = dict(t.folders)
    after = keyedtable.apply(spark, t, make([(5, 2, "b"), (5, 1, "late"), (200, 1, "n")]), latest, "s", 1)
    changed = {b for b, f in after.folders if before[b] != f}
    assert 1 <= len(changed) <= 2
    files = lambda folder: sorted(p.name for p in (tmp_path / "t/data" / folder).glob("*.parquet"))
    assert all(files(f) == files(before[b]) for b, f in after.folders if b not in changed)
    assert {r["k"]: r["v"] for r in keyedtable.read(spark, after).collect()} == {i: "a" for i in range(100)} | {5: "b", 200: "n", None: "null"}
    assert keyedtable.apply(spark, after, make([(5, 9, "again")]), latest, "s", 1) is after  # the batch is known
    assert [r["v"] for r in keyedtable.read(spark, after, [5, 7, 999]).orderBy("k").collect()] == ["b", "a"]
    plan = keyedtable.read(spark, after, [7])
    assert len(plan.inputFiles()) == 1
    with pytest.raises(keyedtable.Conflict):
        keyedtable.apply(spark, t, make([(1, 5, "x")]), latest, "other", 0)
    assert {r["v"] for r in keyedtable.read(spark, keyedtable.load(spark, t.path, 1)).collect()} == {"a", "null"}
    gone = keyedtable.apply(spark, after, make([(1, 3, "x")]), lambda r: latest(r).where("k <> 1 or k is null"), "s", 2)
    assert keyedtable.read(spark, gone).where("k = 1").isEmpty()
    keyedtable.vacuum(spark, gone, 1)
    assert keyedtable.read(spark, keyedtable.load(spark, t.path)).count() == 101
    assert keyedtable.load(spark, t.path) == gone


def test_a_stream_of_batches_equals_one_merge(spark, tmp_path):
    r = random.Random(1)
    for i in range(3):
        rows = [(r.randrange(50), 100 * i + j, f"{i}-{j}") for j in range(80)]
        spark.createDataFrame(rows, "k long, s long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, s long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.merge_stream(stream, str(tmp_path / "t"), "k", latest, str(tmp_path / "c"), 4).awaitTermination()
    t = keyedtable.load(spark, str(tmp_path / "t"))
    assert t.version == 3 and dict(t.applied) == {str(tmp_path / "c"): 2}
    want = latest(spark.read.parquet(str(tmp_path / "in")))
    assert keyedtable.read(spark, t).exceptAll(want).isEmpty() and want.count() == keyedtable.read(spark, t).count()


def test_claims_run_out_once(spark, tmp_path):
    events = [
        [(1, "processing", 5), (2, "processing", 10), (3, "processing", 20), (3, "completed", 30)],
        [(2, "processing", 1000), (4, "processing", 1500), (9, "pending", 1900)],  # 1 has run out by now; 2 is claimed anew
        [(9, "pending", 4000), (1, "processing", 3990)],
    ]
    for i, rows in enumerate(events):
        df = spark.createDataFrame(rows, "id long, status string, s long").select("id", "status", F.timestamp_seconds("s").alias("at"))
        df.coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema("id long, status string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    changes = jobs.run_once(claims.claim_changes(stream, 1800), "update")
    rows = [tuple(r) for r in changes.where("expired").select("id", "at_ms").collect()]
    assert sorted(rows) == [(1, 1_805_000), (2, 2_800_000), (4, 3_300_000)]
    assert {r["id"]: r["status"] for r in claims.current_status(changes).collect()} == {1: "processing", 2: "pending", 3: "completed", 4: "pending", 9: "pending"}


def test_a_stage_batch_runs_once(spark, tmp_path):
    schema = "file_path string, file_name string, file_size long, extension string, file_hash string, modified_time double, created_time double, priority int"
    rows = [("a/x.TXT", "x.TXT", 10, None, "h1", 1.0, 1.0, 5), ("a/a.txt", "a.txt", 10, "", "h1", 1.0, 1.0, 5), ("a/a.txt", "a.txt", 10, "", "h1", 1.0, 1.0, 5), ("b", "b", None, "pdf", "h2", 1.0, 1.0, 5), (None, None, 1, None, None, None, None, None)]
    root = str(tmp_path / "s")
    assert stages.output(spark, root, "files") is None
    assert stages.discover(spark, root, spark.createDataFrame(rows, schema), 0, "w", "2024-01-01T00:00:00Z")
    count = lambda: {n: stages.output(spark, root, n).count() for n in stages.OUTPUTS}
    assert count() == {"files": 1, "queue": 1, "events": 3, "states": 3}
    assert not stages.discover(spark, root, spark.createDataFrame(rows, schema), 0, "w", "2024-01-02T00:00:00Z")
    assert count() == {"files": 1, "queue": 1, "events": 3, "states": 3}
    (Path(root) / "events/batch=1").mkdir(parents=True)  # what a failed attempt left
    assert stages.discover(spark, root, spark.createDataFrame([("c/x", "x", 10, "md", "h1", 1.0, 1.0, 5), ("c/y", "y", 10, "md", "h3", 1.0, 1.0, 1)], schema), 1, "w", "2024-01-02T00:00:00Z")
    assert count() == {"files": 2, "queue": 2, "events": 4, "states": 4}
    assert {r["file_path"] for r in stages.output(spark, root, "files").collect()} == {"a/a.txt", "c/y"}


def test_roots_of_chains_trees_and_cycles(spark, tmp_path):
    pairs = [(i, i - 1) for i in range(1, 200)] + [(1000 + i, 0) for i in range(50)] + [(5001, 5002), (5002, 5003), (5003, 5001), (5004, 5001), (7, 6), (7, 9), (None, 3), (4, None), (8000, 8000)]
    got = {r["c"]: (r["root"], r["depth"]) for r in lineage.roots(spark.createDataFrame(pairs, "c long, p long"), "c", "p", str(tmp_path / "r")).collect()}
    up = {}
    for c, p in pairs:
        if c is not None and p is not None:
            up[c] = min(p, up.get(c, p))
    for c in up:
        at, n = c, 0
        while at in up and n <= len(up):
            at, n = up[at], n + 1
        assert got[c] == ((at, n) if n <= len(up) else (None, None))
    assert len(got) == len(up)
    assert lineage.roots(spark.createDataFrame([], "c long, p long"), "c", "p", str(tmp_path / "e")).count() == 0


def test_exact_quantiles(spark):
    r = random.Random(2)
    for values in ([r.gauss(0, 1) for _ in range(3000)], [5.0] * 2000 + [1.0, 9.0], [1.0], [1.0, 2.0], [float(r.randrange(7)) for _ in range(999)] + [None] * 10):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        held = sorted(v for v in values if v is not None)
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            at = (len(held) - 1) * q
            want = held[math.floor(at)] + (held[math.ceil(at)] - held[math.floor(at)]) * (at - math.floor(at))
            assert quantiles.exact_quantile(df, "x", q, 100) == pytest.approx(want)
    assert quantiles.exact_quantile(df.limit(0), "x", 0.5) is None
    assert quantiles.exact_quantile(df, "x", 0.5) == statistics.median(held)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    v = centres[rng.integers(0, 30, 3000)] + rng.normal(scale=0.4, size=(3000, 16))
    v[::50] = v[0]  # copies
    v[7] = 0
    rows = [(i, None if i == 11 else x.tolist()) for i, x in enumerate(v)]
    base = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    return base, base.where("vec_id % 20 = 0 or vec_id = 7").select(F.col("vec_id").alias("query_id"), "vector")


def test_cells_find_what_brute_force_finds(spark, points, tmp_path):
    base, asked = points
    want = {(r["query_id"], r["vec_id"]) for r in vectors.best_matches(base, asked, 10).collect()}
    index = vectorindex.build(base, str(tmp_path / "i"), CellParams(rows_per_cell=60, probes=4, group_rows=150))
    assert len(index.sizes) > 20
    near = {(r["query_id"], r["vec_id"]) for r in vectorindex.search(index, asked, 10).collect()}
    assert len(near & want) >= 0.9 * len(want)
    exact = {(r["query_id"], r["vec_id"]) for r in vectorindex.search(index, asked, 10, exact=True, scratch=str(tmp_path / "s")).collect()}
    assert exact == want


def test_cells_of_odd_tables(spark, points, tmp_path):
    base, asked = points
    none = vectorindex.build(base.limit(0), str(tmp_path / "n"))
    assert vectorindex.search(none, asked, 3).count() == 0
    few = vectorindex.build(base.where("vec_id < 5"), str(tmp_path / "f"))
    got = vectorindex.search(few, asked.where("query_id = 0"), 9, exact=True, scratch=str(tmp_path / "x")).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2, 3, 4]
    assert vectorindex.search(few, asked.limit(0), 3).count() == 0


def test_phrases_between_edges(spark):
    phrases = ["Invoice", "invoice due", "a b", "c++", ".net", "u.s.", "x_y", "é"]
    p = automaton.Phrases([*phrases, "  ", "INVOICE"])
    texts = ["the invoice due now", "invoices due", "invoice", "xa b", "a b.", "use c++!", "c+++", "asp.net", "the .net", ".net", "u.s. law", "x_y", "x_yz", "é", "éa", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: {p.all[i] for i in r["f"]} for r in df.select("id", p.prepare(F.col("t")).alias("f")).collect()}

    def holds(t, phrase):
        edge = lambda c: not (c.isalnum() or c == "_")
        return any(t[i : i + len(phrase)] == phrase and (i == 0 or edge(t[i - 1])) and (i + len(phrase) == len(t) or edge(t[i + len(phrase)])) for i in range(len(t)))

    assert got == {i: {x for x in p.all if t and holds(t, x)} for i, t in enumerate(texts)}
    votes = automaton.phrase_votes(df, "id", "t", [("invoice", "FIN", 1.0), ("Invoice due", "FIN", 1.5), ("a  b", "X", 2.0), *((f"none {i}", "N", 1.0) for i in range(100_000))])
    assert {(r["id"], r["code"]): r["points"] for r in votes.collect()} == {(0, "FIN"): 2.5, (2, "FIN"): 1.0, (4, "X"): 2.0}


def test_odd_metadata_rows(spark):
    df = spark.createDataFrame([("a", None, "  ", "unknown", "f.txt", "i9")], "`Type` string, type string, `Doc  Category` string, category string, `my file name` string, `the id` string")
    v = metadata.sheet_rows(df, "s").select("values").collect()[0]["values"]
    assert v == {"category": "unknown", "my file name": "f.txt", "the id": "i9"}
    row = spark.createDataFrame([(v | {"doc category": "Memo", "record type code": "R1", "filename": ""},)], "v map<string,string>")
    got = row.select(metadata.explicit_tags(F.col("v")).alias("t"), metadata.join_values(F.col("v")).alias("k"), metadata.extended_values(F.col("v")).alias("e")).first()
    assert got["t"] == {"category": "Memo"} and got["k"] == {"file_name": "f.txt", "doc_id": "i9"} and got["e"] == {"record type code": "R1"}


def test_rows_and_values_by_containment(spark):
    from quire.functions.text import norm
    from quire.operators import tagging

    r = random.Random(9)
    word = lambda n: "".join(r.choice("ab ") for _ in range(n))
    docs = spark.createDataFrame([(i, word(r.randrange(9)), word(r.randrange(7)), r.choice(["k1", "k2", "", None])) for i in range(60)], "doc_id long, name string, path string, key string")
    rows = spark.createDataFrame([(i, word(r.randrange(6)), word(r.randrange(5)), r.choice(["K1", "k3", ""])) for i in range(40)], "row long, rn string, rp string, rk string")
    got = {x["doc_id"]: (x["points"], x["row"]) for x in tagging.best_rows(docs, rows, "doc_id", "row", {"name": "name", "path": "path", "key": "key"}, {"name": "rn", "path": "rp", "key": "rk"}).collect()}
    score = tagging.match_score({"name": F.col("name"), "path": F.col("path"), "key": F.col("key")}, {"name": F.col("rn"), "path": F.col("rp"), "key": F.col("rk")})
    want = {}
    for x in docs.join(rows, score > 0).select("doc_id", "row", score.alias("s")).collect():
        want[x["doc_id"]] = max(want.get(x["doc_id"], (0, 0)), (x["s"], -x["row"]))
    assert got == {k: (s, -n) for k, (s, n) in want.items()} and len(got) > 30
    values = tagging.allowed_value(docs, rows.select(F.col("rn").alias("value")), "name")
    full = docs.select("name").distinct().withColumn("c", norm(F.col("name"))).join(rows.select(F.col("rn").alias("value"), norm(F.col("rn")).alias("a")).where("a <> ''").distinct(), (F.col("c") == F.col("a")) | ((F.length("c") >= 4) & (F.col("a").contains(F.col("c")) | F.col("c").contains(F.col("a")))))
    first = {x["name"]: (x["m"]["t"], x["m"]["value"]) for x in full.groupBy("name").agg(F.min(F.struct(F.when(F.col("c") == F.col("a"), 1).otherwise(2).alias("t"), "value")).alias("m")).collect()}
    tiers = {"exact": 1, "partial": 2}
    assert {x["name"]: (tiers[x["mode"]], x["value"]) for x in values.collect() if x["mode"] in tiers} == first


def test_many_claims_run_out_from_one_bucket(spark, tmp_path):
    """As taken one by one: open claims of a bucket that end at different times, equal times, and events without an id."""
    r = np.random.default_rng(3)
    parts = [[(int(i) if i < 40 else None, ["processing", "completed", "failed", "pending"][s], int(t)) for i, s, t in zip(r.integers(0, 41, 120), r.choice(4, 120, p=[0.7, 0.1, 0.1, 0.1]), 5000 * n + r.integers(0, 5000, 120))] for n in range(3)]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, "id long, status string, s long").select("id", "status", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
    stream = spark.readStream.schema("id long, status string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    want, events = [], sorted(((i, t, s) for rows in parts for i, s, t in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
    latest = max(t for _, t, _ in events)
    for (i, t, s), (j, u, _) in zip(events, [*events[1:], (-1, 0, "")]):
        want.append((i, s, t * 1000, False))
        if s == "processing" and (t + 600 <= u if i == j else t + 600 < latest):
            want.append((i, "pending", (t + 600) * 1000, True))
    got = [tuple(x) for x in jobs.run_once(claims.claim_changes(stream, 600, buckets=2), "update").collect()]
    order = lambda x: tuple((v is None, v or 0) for v in x[:1]) + x[1:]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_blocks_of_pairs_find_what_brute_force_finds(spark, points):
    base, asked = points
    want = {(r["query_id"], r["vec_id"]) for r in vectors.best_matches(base, asked, 10).collect()}
    assert {(r["query_id"], r["vec_id"]) for r in vectorindex.nearest(base, asked, 10, few=20).collect()} == want  # copies tie by id
    assert {(r["query_id"], r["vec_id"]) for r in vectorindex.in_blocks(base, asked, 10, block_rows=70).collect()} == want
    assert vectorindex.in_blocks(base, asked.limit(0), 3).count() == 0 and vectorindex.in_blocks(base.limit(0), asked, 3).count() == 0
    plan = vectorindex.nearest(base, asked, 10, few=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "asked" in plan  # no query is sent to every cell


def test_rows_are_not_dealt_by_label(spark):
    allowed = spark.createDataFrame([("Invoice",), ("Own label",)], "value string")
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "invoice").when(F.col("id") % 2 == 0, F.concat(F.lit("label "), F.col("id") % 50)).alias("__l"))
    want = rows.join(tagging.allowed_value(rows, allowed, "__l"), "__l", "left").select("id", "__l", "value", "mode")
    for few, often in ((100, 100), (5, 500), (5, 5), (5, 10_000)):
        got = tagging._with_modes(rows, allowed, few, often).select(*want.columns)
        assert got.count() == 3000 and got.exceptAll(want).isEmpty()
    plan = tagging._with_modes(rows, allowed)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan

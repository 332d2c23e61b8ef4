"""Golden values of scalar functions, parsers and state rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import accuracy as A
from quire.functions import analysis
from quire.functions import text as T
from quire.operators import dedup, filterlang, queues, review, search, state, tagging, vectors


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_bloom_sizing(spark):
    x = A.bloom_size(F.lit(10_000_000.0), F.lit(0.001))
    assert tuple(one(spark, x["m"], x["k"])) == (143_775_875, 9)


def test_corrections(spark):
    t = "Total Assests 2041, sale prlce $97 621 and ($5 000) on June 45 | MuItisite fulIy"
    r = one(spark, T.correct(F.lit(t)).alias("c"))["c"]
    assert r["text"] == "total assets 2011, sale price $97,621 and ($5,000) on June 30 I Multisite fully"
    assert r["corrections"] == 9


def test_corrections_keep_clean_text(spark):
    r = one(spark, T.correct(F.lit("nothing to do")).alias("c"), T.correct(F.lit(None).cast("string")).alias("n"))
    assert tuple(r["c"]) == ("nothing to do", 0) and tuple(r["n"]) == ("", 0)


@pytest.mark.parametrize(("text", "want"), [("Strictly  Confidential memo", "Confidential"), ("not confidential", "Public"), ("internal use", "Internal"), ("unrestricted restricted", "Public"), (None, "Public")])
def test_confidentiality(spark, text, want):
    assert one(spark, T.confidentiality(F.lit(text).cast("string")))[0] == want


def test_identity(spark):
    r = one(spark, T.smart_id(F.lit("Finance"), F.lit("2024-02-03T00:00:00Z"), F.lit("abc"), "20260101"), T.smart_id(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(""), "20260101"), T.file_key(F.lit(None).cast("string"), F.lit(7), F.lit("p")))
    assert r[0] == "FIN-20240203-A999" and r[1].startswith("DOC-20260101-") and r[2] == "file-7"


@pytest.mark.parametrize(("q", "want"), [("\\uid:123", ("uid", "123")), ("/person:Doe", ("person", "Doe")), ("/l:Paris", ("location", "Paris")), ("/conf:Top Secret", ("confidentiality", "Top Secret")), ("/pdf", ("ext", "pdf")), ("/ABC-12345678-ABCD", ("uid", "ABC-12345678-ABCD")), ("plain", None), ("/", None), ("/foo bar", ("tag", "foo bar"))])
def test_slash(q, want):
    assert search.parse_slash(q) == want


@pytest.mark.parametrize(("q", "mode"), [('"a b"', "phrase"), ("$1,200", "numeric"), ("c:\\x\\y.pdf", "path"), ("two words", "terms"), ("/ext:pdf", "slash")])
def test_router(q, mode):
    assert search.parse(q).mode == mode


def test_paging(spark):
    df = spark.range(100).withColumn("score", F.lit(1.0))
    a, b = ({r["id"] for r in search.page_of(df, [F.col("id")], p, 10).collect()} for p in (1, 2))
    assert len(a) == len(b) == 10 and not a & b
    with pytest.raises(ValueError, match="window"):
        search.page_of(df, [F.col("id")], 1001, 10)


@pytest.mark.parametrize("q", ["AND status:x", "status:x OR", "nope:1", "status:", "a AND OR b"])
def test_filter_errors(q):
    with pytest.raises(ValueError):
        filterlang.parse(q, {"status": "s"})


def test_filter_left_to_right(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "s string, n int")
    p = filterlang.predicate("s:a OR s:b AND n:2", {"s": "s", "n": "n"}, ["s"])
    assert [r["s"] for r in df.where(p).collect()] == ["b"]


def test_weighted_accuracy(spark):
    pages = spark.createDataFrame([(1, 1, 60.0, 100.0), (1, 2, 94.74, 95.0), (1, 3, 100.0, 100.0), (2, 1, 95.0, 10.0), (3, 1, 87.63, 10.0), (4, 1, 78.0, 0.0)], "doc_id long, page long, base double, weight double")
    reviews = spark.createDataFrame([(2, 1, "accepted", "text", 3.0), (2, 1, "accepted", "text", 3.0), (3, 1, "accepted", "logo", 12.0), (4, 1, "rejected", "text", 9.0)], "doc_id long, page long, status string, snippet_type string, impact double")
    got = {r["doc_id"]: r["accuracy"] for r in review.document_accuracy(pages, reviews).collect()}
    assert got[1] == pytest.approx((60 * 100 + 94.74 * 95 + 100 * 100) / 295)
    assert (got[2], got[3], got[4]) == (100.0, 87.63, 78.0)


def test_forced_constraint(spark):
    c = tagging.constrain(F.lit(0.90), F.lit("partial"))
    assert tuple(one(spark, c.alias("c"))["c"]) == (0.75, True, "forced")


def test_state_merge_is_idempotent(spark):
    e = spark.createDataFrame([(1, 1, "a", "x", 5.0, "t"), (1, 2, "b", "", 0.0, "tagging"), (1, 3, "c", None, 7.0, "o")], "k int, seq int, status string, note string, score double, stage string")
    rules = state.Rules(keep=("note",), positive=("score",), always=("status",), stage=())
    a = state.merge_events(e, "k", "seq", rules).collect()
    assert a == state.merge_events(e.unionAll(e), "k", "seq", rules).collect()
    assert (a[0]["note"], a[0]["score"], a[0]["status"]) == ("x", 7.0, "c")


def test_owner_stage_overwrites_with_blank(spark):
    e = spark.createDataFrame([(1, 1, "old", "x"), (1, 2, "", "tagging")], "k int, seq int, label string, stage string")
    assert state.merge_events(e, "k", "seq", state.Rules(stage=("label",))).first()["label"] == ""


def test_ocr_update_fills_only_missing_content(spark):
    base = spark.createDataFrame([(1, "", None, None), (2, "text", None, None)], "doc_id int, main_content string, ocr_content string, ocr_confidence double")
    ocr = spark.createDataFrame([(1, "seen", 80.0), (2, "other", 70.0), (3, "new", 60.0)], "doc_id int, ocr_content string, ocr_confidence double")
    got = {r["doc_id"]: r["main_content"] for r in state.ocr_update(base, ocr).collect()}
    assert got == {1: "seen", 2: "text", 3: "new"}


def test_dedup_empty_content_is_never_duplicate(spark):
    df = spark.createDataFrame([(1, ""), (2, ""), (3, "A b"), (4, "a  B")], "doc_id long, text string")
    got = {r["doc_id"]: r["is_duplicate"] for r in dedup.mark_duplicates(df, T.content_hash(F.col("text")), ["doc_id"]).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True}


def test_stale_claims(spark):
    df = spark.sql("select 1 as id, 'processing' as status, timestamp '2024-01-01 00:00:00' as claimed_at union all select 2, 'processing', timestamp '2024-01-01 00:59:00'")
    got = {r["id"]: r["status"] for r in queues.reset_stale(df, F.expr("timestamp '2024-01-01 01:00:00'"), 1800).collect()}
    assert got == {1: "pending", 2: "processing"}


@pytest.mark.parametrize(("w", "s"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("adjustable", "adjust"), ("controll", "control"), ("sky", "sky")])
def test_porter(w, s):
    assert analysis.porter(w) == s


def test_cosine(spark):
    r = one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))))
    assert r[0] == pytest.approx(0.5**0.5) and r[1] == 0.0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["status:a", "name:b", '"c d"', "e"]), min_size=1, max_size=5), st.lists(st.sampled_from(["AND", "OR"]), min_size=5, max_size=5))
def test_filter_parses_all_chains(terms, ops):
    q = terms[0] + "".join(f" {o} {t}" for o, t in zip(ops, terms[1:], strict=False))
    assert len(filterlang.parse(q, {"status": "s", "name": "n"})) == len(terms)

"""The inverted index against plain counting, its bounds, appends and what a query reads."""

import math
import random
import re

import pytest

from quire.operators import textindex
from quire.operators.textindex import Layout

WORDS = "of the report analysis summary with und a b c d e f g h".split()


def corpus(n, seed, first=0):
    r = random.Random(seed)
    rows = []
    for i in range(first, first + n):
        text = " ".join(r.choices(WORDS, [2, 6, 1, 1, 1, 3, 3, *[2] * 8], k=int(math.exp(r.uniform(0, 6)))))
        rows.append((i, None if i % 41 == 0 else text, r.choice(["the report", "summary: OF THE", "", "b-b"])))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus(900, 1) + corpus(500, 2, 900)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    lay = Layout(buckets=4, block_docs=10)
    make = lambda part: spark.createDataFrame(part, "id long, text string, title string")
    textindex.append(path, make(rows[:900]), "id", ["text", "title"], "one", lay)
    return textindex.append(path, make(rows[900:]), "id", ["text", "title"], "two", lay)


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def ranked(rows, terms, at=1, k1=1.2, b=0.75):
    docs = {r[0]: tokens(r[at]) for r in rows}
    mean = sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for t in terms}
    out = {}
    for i, d in docs.items():
        s = 0
        for t in terms:
            if tf := d.count(t):
                s += math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean))
        if s:
            out[i] = s
    return out


def test_scores_and_the_k_best(index, rows):
    terms = ["report", "und", "a", "a"]
    want = ranked(rows, ["report", "und", "a"])
    got = {r["key"]: r["score"] for r in textindex.bm25(index, "text", terms).collect()}
    assert got == pytest.approx(want)
    order = sorted(want, key=lambda i: (-round(want[i], 9), i))
    for k in (1, 7, 50, 5000):
        found = textindex.top_k(index, "text", terms, k)
        assert [r["key"] for r in found.rows.collect()] == order[:k]
        assert found.decoded <= found.blocks == 140
    assert textindex.top_k(index, "text", ["report"], 1, first_blocks=1).decoded < 70
    assert textindex.top_k(index, "text", ["absent"], 3).rows.count() == 0


def test_k_best_with_joined_blocks(index, rows, monkeypatch):
    monkeypatch.setattr(textindex, "LISTED_BLOCKS", 3)
    want = ranked(rows, ["report", "und"])
    found = textindex.top_k(index, "text", ["report", "und"], 20)
    assert [r["key"] for r in found.rows.collect()] == sorted(want, key=lambda i: (-round(want[i], 9), i))[:20]


def test_bounds_hold_when_the_mean_has_moved(index, rows):
    for terms in (["the"], ["report", "und", "c"]):
        known = textindex.facts(index, terms)
        bounds = {(r["segment"], r["block"]): r["bound"] for r in textindex.block_bounds(index, "text", terms, known).collect()}
        per_block = textindex.postings(index, terms).where("field = 'text'").selectExpr("segment", "block", "explode(keys) as key").distinct().collect()
        scores = ranked(rows, terms)
        assert all(scores[r["key"]] <= bounds[r["segment"], r["block"]] for r in per_block)


def test_matches_and_phrases(index, rows):
    terms = ["of", "report", "summary", "h"]
    got = {r["key"]: r["matched"] for r in textindex.term_matches(index, "text", [*terms, "of"], 3).collect()}
    assert got == {r[0]: n for r in rows if (n := sum(t in tokens(r[1]) for t in terms)) >= 3}

    def count(t, words):
        return sum(t[i : i + len(words)] == words for i in range(len(t)))

    for words in (["the"], ["of", "the"], ["the", "report", "the"], ["the", "the"], ["b", "b"]):
        got = {(r["field"], r["key"]): r["freq"] for r in textindex.phrase_counts(index, ["text", "title"], words).collect()}
        assert got == {(f, r[0]): n for r in rows for f, at in (("text", 1), ("title", 2)) if (n := count(tokens(r[at]), words))}
    both = {r["key"]: r["score"] for r in textindex.phrase_matches(index, {"text": 2.0, "title": 5.0}, ["of", "the"]).collect()}
    assert set(both.values()) <= {2.0, 5.0, 5.2} and len(both) > 300
    assert textindex.phrase_matches(index, {"text": 2.0}, []).count() == 0


def test_blending_over_fields(index, rows):
    group = {"report": ["report", "analysis", "summary"]}
    got = {r["key"]: r["score"] for r in textindex.blended(index, {"text": 2.0, "title": 5.0}, ["of", "the", "report"], lambda w: group.get(w, [w])).collect()}
    docs = {r[0]: {"text": tokens(r[1]), "title": tokens(r[2])} for r in rows}
    n, mean = len(docs), {f: sum(len(d[f]) for d in docs.values()) / len(docs) for f in ("text", "title")}
    df = {(f, w): sum(w in d[f] for d in docs.values()) for f in mean for w in WORDS}
    idf = lambda x: math.log(1 + (n - x + 0.5) / (x + 0.5))
    part = lambda tf, length, m: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))
    want, boost = {}, {"text": 2.0, "title": 5.0}
    for i, d in docs.items():
        each = []
        for t in ("of", "the", "report"):
            syn = group.get(t, [t])
            w = idf(max(df[f, s] for f in mean for s in syn))
            each.append(max(boost[f] * w * part(tf, len(d[f]), mean[f]) if (tf := sum(map(d[f].count, syn))) else 0 for f in mean))
        if sum(x > 0 for x in each) >= 2:
            phrase = [(f, sum(d[f][j : j + 3] == ["of", "the", "report"] for j in range(len(d[f])))) for f in mean]
            want[i] = sum(each) + max(2 * boost[f] * sum(idf(df[f, w]) for w in ("of", "the", "report")) * part(c, len(d[f]), mean[f]) if c else 0 for f, c in phrase)
    assert got == pytest.approx(want)


def test_reads_the_terms_buckets_only(index):
    plan = textindex.term_matches(index, "text", ["report"], 1)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters")[1] and "EqualTo(term,report)" in scan.replace(" ", "")
    assert "positions" not in scan.split("ReadSchema")[1]


def test_incomplete_and_repeated_segments(spark, rows, tmp_path):
    path, lay = str(tmp_path / "i"), Layout(buckets=2, block_docs=50)
    make = lambda part: spark.createDataFrame(part, "id long, text string, title string")
    textindex.append(path, make(rows[:200]), "id", ["text"], "a", lay)
    whole = textindex.append(path, make(rows[200:300]), "id", ["text"], "b", lay)
    again = textindex.append(path, make(rows[200:300]), "id", ["text"], "b", lay)  # a retried append changes nothing
    want = ranked(rows[:300], ["report"])
    for i in (whole, again):
        assert {r["key"]: r["score"] for r in textindex.bm25(i, "text", ["report"]).collect()} == pytest.approx(want)
    (tmp_path / "i" / "fields" / "segment=s-b").rename(tmp_path / "gone")  # as if the append had failed before its last step
    assert {r["key"] for r in textindex.bm25(textindex.load(spark, path, lay), "text", ["report"]).collect()} == set(ranked(rows[:200], ["report"]))
    empty = textindex.append(str(tmp_path / "e"), make([(1, None, "x"), (2, "", "x")]), "id", ["text", "title"], "a", lay)
    assert textindex.bm25(empty, "text", ["x"]).count() == 0 and textindex.bm25(empty, "title", ["x"]).count() == 2


def test_only_texts_are_shuffled_so_a_common_term_is_written_by_many_tasks(index):
    at = textindex.postings(index, ["the"]).where("field = 'text'").selectExpr("segment", "input_file_name() as f").distinct().groupBy("segment").count().collect()
    assert len(at) == 2 and all(r["count"] > 1 for r in at)  # before, a bucket of terms was one task


def test_bounds_hold_for_the_mean_of_some_documents(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "MEAN_DOCS", 5)
    i = textindex.append(str(tmp_path / "i"), spark.createDataFrame(rows, "id long, text string, title string"), "id", ["text"], "a", Layout(buckets=2, block_docs=20))
    want = ranked(rows, ["report", "und"])
    assert [r["key"] for r in textindex.top_k(i, "text", ["report", "und"], 20).rows.collect()] == sorted(want, key=lambda i: (-round(want[i], 9), i))[:20]
    assert i.parts[0][2:] == (len(rows), sum(len(tokens(r[1])) for r in rows))

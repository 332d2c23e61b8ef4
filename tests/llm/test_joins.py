"""Near duplicates, passages and benchmark leaks against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quire.llm import blobs, components, decontaminate, jaccard_join, substring_dedup
from tests.llm import brute

EMPTY = "doc_id long, text string"


def near_copies(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(14):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 6, 20, 60, 150]))]
        for _ in range(r.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(w + [r.choice(vocabulary) for _ in range(r.choice([0, 3]))])))
    hot = [r.choice(vocabulary) for _ in range(60)]
    rows += [(1000 + k, " ".join(hot + [r.choice(vocabulary) for _ in range(r.choice([5, 12, 14, 16, 18, 20, 40]))])) for k in range(60)]
    return rows + [(5000, ""), (5001, None), (5002, " \n"), (5003, "a"), (5004, "A"), (5005, "a b c d"), (5006, "x " * 3000), (5007, "X " * 3000)]


def test_components_equal_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows + [rows[3], (None, "a b c")], EMPTY).withColumn("key", F.lit(1)).withColumn("n", F.lit("x"))
    got = jaccard_join.jaccard_components(df).collect()
    want = brute.components(rows)
    assert len(got) == len(rows) + 1  # a repeated row stays, a row without an id doesn't
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)


@pytest.mark.parametrize("most", [1, 4])
def test_components_of_short_blocks(spark, most):
    rows = near_copies(7)
    p = jaccard_join.JoinParams(most_matches=most, long_list=3, queries_per_block=5, members_per_block=9, broadcast_rows=3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, EMPTY), p).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows).items()}


def test_components_of_nothing(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], EMPTY)).count() == 0


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "en"), (1, "a b c d e f", "fr"), (2, "other words stand here now", None), (None, "a b c d e f", "x")], "doc_id long, text string, lang string")
    out = jaccard_join.near_duplicates_removed(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {1, 2, None}


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["component"] for r in components.connected_components(edges).collect()} == {0, 100}


def test_keys_deal_evenly(spark):
    for n in (1, 7, 48):
        df = spark.createDataFrame([(int(k),) for k in blobs.keys_of(n)], "key int").repartition(n, "key")
        assert sorted(r[0] for r in df.select(F.spark_partition_id()).collect()) == list(range(n))


def passages():
    r = random.Random(3)
    sentence = lambda: " ".join(r.choice("abcdefghijkl") * r.randint(2, 5) for _ in range(r.randint(1, 14))).capitalize() + r.choice(".!?")
    shared = [" ".join(sentence() for _ in range(9)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [" ".join(sentence() for _ in range(r.randint(0, 6)))]
        parts += [r.choice(shared), "und so weiter " + r.choice(shared)] if i % 3 else []
        rows.append((i, "\n".join(parts)))
    return [*rows, (900, None), (901, ""), (902, "Kurz."), (903, shared[0].upper()), (904, "Eins zwei drei. " * 30)]


def test_passages_equal_brute_force(spark):
    rows = passages()
    p = substring_dedup.SpanParams()
    df = spark.createDataFrame([(i, t, 5) for i, t in rows] + [(None, rows[1][1], 5), (rows[1][0], rows[1][1], 5)], "doc_id long, text string, n_removed long")
    got = substring_dedup.dedup_spans(df, p)
    assert got.columns == ["doc_id", "text", "n_removed"]
    want = brute.without_spans(rows, p)
    assert got.count() == len(rows) + 2
    for r in got.collect():
        if r["doc_id"] is None:
            assert r["text"] == rows[1][1]
        else:
            assert ((r["text"] or "").split(), r["n_removed"]) == want[r["doc_id"]], r["doc_id"]
    assert sum(n for _, n in want.values()) > 1000


def test_white_space_of_kept_text_stays(spark):
    one = "Ein  Satz\tmit Raum.\n\nNoch einer hier."
    df = spark.createDataFrame([(1, one)], EMPTY)
    assert substring_dedup.dedup_spans(df).first()["text"] == one
    assert substring_dedup.dedup_spans(df.limit(0)).count() == 0


def leaky():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    items = [(j, " ".join(word() for _ in range(r.randint(12, 50)))) for j in range(12)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 80))]
        if i % 2:
            part = items[i % 12][1].split()
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                part[r.randrange(len(part))] = word()
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() + r.choice(["", ",", "!"]) for x in part]
        docs.append((i, " ".join(w)))
    return docs + [(900, None), (901, ""), (902, items[0][1]), (903, " ".join(items[1][1].split()[:-2]))], [*items, (50, None), (51, ""), (52, items[0][1])]


def test_leaks_equal_brute_force(spark):
    docs, items = leaky()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in [*docs, docs[1], (None, docs[1][1])]], "doc_id long, text string, w string, start int")
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("length", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(d, b).collect()}
    want = brute.leaks(docs, items)
    assert len(want) > 10 and set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_recall_and_selectivity_of_the_index(spark):
    """Items with edits that leave a similarity of about 0.75 to 0.9: recall against all windows, and pairs that the index joins."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    items = [(j, " ".join(word() for _ in range(r.choice([30, 40])))) for j in range(40)]
    docs = []
    for i in range(240):
        part = items[i % 40][1].split()
        part[r.randrange(len(part))] = word()
        w = [word() for _ in range(8)]
        docs.append((i, " ".join(w[:4] + part + w[4:])))
    d, b = spark.createDataFrame(docs, EMPTY), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(d, b).collect()}
    want = brute.leaks(docs, items)
    assert len(want) > 150 and got <= set(want) and len(got) >= 0.95 * len(want)
    prints = lambda n, name: spark.range(n).select(F.col("id").alias(name), F.lit(40).alias("length"), F.xxhash64("id", F.lit(name)).alias("print"))
    unlike = decontaminate.candidates(prints(400, "k"), prints(300, "item"), decontaminate.DecontaminationParams(), "k").count()
    assert unlike < 0.001 * 400 * 300
    values = decontaminate.block_values(F.col("print"), 6), decontaminate.block_values(F.col("print"), 6, 2)
    met = prints(400, "k").select("k", F.explode(values[0]).alias("b")).join(prints(300, "item").select("item", F.explode(values[1]).alias("b")), "b").select("k", "item").distinct().count()
    assert met < 0.3 * 400 * 300


def test_repeated_ids_leak_what_any_of_their_texts_does(spark):
    items = [(1, " ".join(f"q{i}" for i in range(30))), (1, " ".join(f"z{i}" for i in range(25)))]
    docs = [(7, "nothing"), (7, items[0][1]), (8, "x " * 200_000 + items[1][1]), (9, None)]
    d, b = spark.createDataFrame(docs, EMPTY).withColumn("print", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("c"))
    assert sorted((x["doc_id"], x["start"]) for x in decontaminate.leaks(d, b).collect()) == [(7, 0), (8, 200_000)]
    assert [x["doc_id"] for x in decontaminate.decontaminated(d, b).collect()] == [9]


def test_leaks_by_shuffle_join_and_of_nothing(spark):
    docs, items = leaky()
    d, b = spark.createDataFrame(docs, EMPTY), spark.createDataFrame(items, "item_id long, text string")
    p = decontaminate.DecontaminationParams(broadcast_rows=1)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b, p).collect()} == {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()}
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0
    assert decontaminate.decontaminated(d, b.limit(0)).count() == len(docs)


def test_short_items_are_found_whole(spark):
    d = spark.createDataFrame([(1, "say alpha beta gamma now"), (2, "alpha gamma beta")], EMPTY)
    b = spark.createDataFrame([(1, "Alpha beta, gamma")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(d, b).collect()] == [1]

"""Filter audit, pattern packing and importance resampling against plain versions."""

import hashlib
import math
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import filter_audit, importance, pattern_packing

ODD = "doc_id long, text string, source string, digest string, failed int, part string, place long, rank long, g int, bucket int"


def rows_with_odd_columns(spark, rows):
    """(doc_id, text, source) with further columns named like the operators' own."""
    return spark.createDataFrame([(*r, "x", 3, "y", 5, 7, 1, 9) for r in rows], ODD)


def prose(n, *, word="w"):
    return " ".join(f"{word}{i}" for i in range(n))


CASES = [
    (1, prose(250), "a"), (2, prose(250), "b"), (2, prose(250), "b"), (3, None, "a"), (4, "", None), (None, prose(250), "a"), (None, None, None), (5, "x " * 300, "a"), (6, prose(210).upper(), "a"), (7, prose(300) + " #", "b"),
    (8, "Ä" * 500_000 + " " + prose(220), "b"), (9, prose(250, word="v"), "b"), (10, "x " * 300, "c"), (11, prose(199), ""), (12, prose(200), ""),
]


# op11
def audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = {}
    for i, t, s in rows:
        t = t or ""
        w = t.encode().split()
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i,
        }
        good, toxic = (max((x[k] or 0 for x in labels if x[0] is not None and x[0] == i), default=0) == 1 for k in (1, 2))
        for order in permutations("ABCDE"):
            early = False
            for k, f in enumerate(order):
                r = out.setdefault((s or "", "".join(order), k + 1), [0] * 6)
                late = fails[f]
                r[0] += not early and not late
                r[1] += late and not early
                r[2] += late and early
                r[3] += late and sum(fails.values()) == 1
                r[4] += late and not early and good
                r[5] += late and not early and toxic
                early |= late
    share = {}
    for (s, order, k), r in out.items():
        share[s, order[k - 1]] = share.get((s, order[k - 1]), 0) + r[1]
    return {key: (*r, share[key[0], key[1][key[2] - 1]]) for key, r in out.items()}


def test_audit_of_odd_rows(spark):
    labels = [(1, 1, 0), (2, 1, 1), (5, 0, 1), (6, None, 1), (6, 1, None), (None, 1, 1), (99, 1, 1), (10, 1, 1)]
    table = spark.createDataFrame([(*x, "l") for x in labels], "doc_id long, quality int, toxic int, failed string")
    got = filter_audit.filter_audit(rows_with_odd_columns(spark, CASES), table).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got}
    assert len(got) == len(found) == 4 * 600
    assert found == audit(CASES, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(rows_with_odd_columns(spark, []), labels).count() == 0
    assert filter_audit.filter_audit(rows_with_odd_columns(spark, CASES[:1]), labels).count() == 600


# op12
@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda t: np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")


def packed(rows, ids_of, sequence):
    """Checks the pieces of (doc_id, text) rows with distinct ids; the number of sequences."""
    texts, seen, filled = dict(rows), {}, {}
    for r in rows:
        seen[r[0]] = []
    for p in packed.pieces:
        ids = ids_of(texts[p["doc_id"]])
        part = ids[p["start"] : p["start"] + p["length"]]
        assert p["start"] == sequence * p["piece"] and p["length"] == min(sequence, len(ids) - p["start"]) and p["ids_crc32"] == zlib.crc32(part.tobytes())
        seen[p["doc_id"]].append(p["piece"])
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, pieces in seen.items():
        assert sorted(pieces) == list(range(-(-len(ids_of(texts[i])) // sequence)))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= sequence
    return len(filled)


def test_whole_table_has_the_librarys_ids_and_fills_sequences(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    packed.pieces = pattern_packing.op12_pattern_packing(spark, sf_dir).collect()
    n = packed(rows, library, 4096)
    assert n <= math.ceil(sum(len(library(t)) for _, t in rows) / 4096) + 1


def test_packing_of_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "Σς ΑΣ İstanbul it's I'LL ﬁ né <|endoftext|>x a\x1cb c"), (4, "Wort, Wort. wort%%% " * 20_000), (5, "a" * 300_000), (6, "中文" * 3000), (None, "null id"), (7, "|a| x|")]
    df = rows_with_odd_columns(spark, [(*r, None) for r in rows])
    packed.pieces = pattern_packing.pack_patterns(df).collect()
    packed(rows, library, 4096)
    twice = pattern_packing.pack_patterns(df.unionAll(df), pattern_packing.PatternParams(sequence=64, grid=8, group_pieces=500)).collect()
    total = {}
    for p in twice:
        total[p["sequence_id"]] = total.get(p["sequence_id"], 0) + p["length"]
    assert max(total.values()) <= 64 and len(twice) == 2 * sum(-(-len(library(t)) // 64) for _, t in rows)
    assert pattern_packing.pack_patterns(df.limit(0)).count() == 0


def test_remembered_chunks_may_be_dropped(library):
    tight = pattern_packing.Encoder("word_bpe_49k.json", 2000)
    for t in ("one two three. " * 5, prose(300), "x" * 200 + " y", prose(40)):
        assert tight(t) == library(t)[:-1].tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAßÉıİΣσ中éͅ \t\x1c\x85 ​'s.|<>0٣①ªﬁK\U0001f600"), max_size=40))
def test_chunks_give_the_librarys_ids(library, text):
    assert pattern_packing.encoder("word_bpe_49k.json", 1_000_000)(text) == library(text)[:-1].tobytes()


def test_patterns_and_least_squares():
    assert sorted(pattern_packing.enumerate_patterns(5, 3)) == sorted([(5,), (4, 1), (3, 2), (3, 1, 1), (2, 2, 1)])
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.normal(size=(12, 20)), rng.normal(size=12)
        x = pattern_packing.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-6).all() and np.abs(g[x > 0]).max(initial=0) < 1e-6  # the conditions of the optimum


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=400))
def test_placing_is_whole_and_dense(lengths):
    p = pattern_packing.PatternParams(sequence=64, grid=4)
    sizes = np.sort(np.array(lengths))[::-1]
    fitted = pattern_packing.fit(np.bincount(sizes, minlength=65), p)
    bins, offsets, _ = pattern_packing.place(sizes, [(x, round(n)) for x, n in fitted], p)
    space = np.zeros(bins.max() + 1, int)
    for b, at, n in sorted(zip(bins.tolist(), offsets.tolist(), sizes.tolist(), strict=True)):
        assert space[b] == at
        space[b] += n
    assert space.max() <= 64 and len(space) <= math.ceil(11 / 9 * math.ceil(sizes.sum() / 64) + sum(sizes > 32) + 1)


def test_patterns_place_most_pieces_of_a_large_table():
    rng = np.random.default_rng(7)
    sizes = np.sort(np.clip(np.exp(rng.normal(6.3, 0.9, 40_000)), 3, 4096).astype(int))[::-1]
    p = pattern_packing.PatternParams()
    fitted = pattern_packing.fit(np.bincount(sizes, minlength=4097), p)
    bins, _, by_patterns = pattern_packing.place(sizes, [(x, round(n)) for x, n in fitted], p)
    assert by_patterns > 0.7 * len(sizes)
    assert sizes.sum() / 4096 / (bins.max() + 1) > 0.998


# op13
def resampled(rows, target, p):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % p.buckets for n in range(1, p.longest + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(p.buckets), np.zeros(p.buckets)
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    out = []
    for i, text, _ in rows:
        n, f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s.sum() + p.buckets) / ((s[b] + 1) * (t.sum() + p.buckets)))) for b in f)
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= p.min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = len(able) * p.percent // 100
    for r in out:
        r[4] = None
    for k, r in enumerate(able[:drawn]):
        r[4] = k + 1
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_of_odd_rows(spark, longest):
    rows = [*CASES, (20, "Ünï-Çode ÄÖ " * 12, None), (21, "one  two,THREE\x7f4 " * 9, None), *((30 + i, prose(18 + i), "s") for i in range(12))]
    target = ["w1 w2 w3", None, "", "Two three two"]
    p = importance.ImportanceParams(longest=longest, buckets=500, percent=40)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(rows_with_odd_columns(spark, rows), table, p).collect()
    assert sorted(repr(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank"))) for r in got) == resampled(rows, target, p)


def test_resampling_of_nothing(spark):
    docs, target = rows_with_odd_columns(spark, CASES), spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target).count() == len(CASES)

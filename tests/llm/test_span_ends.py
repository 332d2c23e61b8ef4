"""Sentences, and passages that are covered up to their last one."""

import random

import numpy as np
import pytest

from quire.llm import substring_dedup
from quire.llm.substring_dedup import SpanParams
from tests.llm import brute
from tests.llm.test_joins import passages

SCHEMA = "doc_id long, text string"


def sentence(word, n):
    return " ".join([word.capitalize(), *[word] * (n - 2), word + "."])


def cut(spark, rows, p=SpanParams()):
    return {r["doc_id"]: (r["text"].split() if r["text"] else [], r["n_removed"]) for r in substring_dedup.dedup_spans(spark.createDataFrame(rows, SCHEMA), p).collect()}


def test_last_sentences_of_a_passage_go(spark):
    passage = " ".join(sentence(x, n) for x, n in (("eins", 12), ("zwei", 12), ("drei", 12), ("vier", 5)))
    rows = [(1, f"{sentence('ab', 9)} {passage} {sentence('cd', 30)}"), (2, f"{sentence('ef', 7)} {passage} {sentence('gh', 25)}"), (3, passage)]
    got = cut(spark, rows)
    assert got[1][1] == 0
    assert got[2] == (f"{sentence('ef', 7)} {sentence('gh', 25)}".split(), 41)
    assert got[3] == ([], 41)


@pytest.mark.parametrize("p", [SpanParams(), SpanParams(3, 8, 25)])
def test_passages_equal_brute_force(spark, p):
    rows = passages()
    assert cut(spark, rows, p) == brute.without_spans(rows, p)


def test_names_make_no_sentences():
    words, edges, begun = substring_dedup.edges_of("we saw Anna and Bob in Paris with Carl near Rome. then home")
    assert edges.tolist() == [0, 2, 4, 6, 8, 10, 11, 13] and begun.tolist() == [1, 1, 1, 1, 1, 1, 2, 3]
    assert len(substring_dedup.runs("we saw Anna and Bob in Paris with Carl near Rome and Eva in Oslo with Finn and Gus by Hull and more", SpanParams())[0]) == 0


ZH = "今天天气很好。我们去公园散步，看到很多花！然后回家吃饭。"
TH = "วันนี้อากาศดีมาก เราไปเดินเล่นที่สวน แล้วกลับบ้าน"


@pytest.mark.parametrize("passage", [ZH, TH])
def test_scripts_without_spaces(spark, passage):
    rows = [(1, passage), (2, "昨天下雨了。" + passage if passage == ZH else "เมื่อวานฝนตก " + passage), (3, "другой текст")]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["text"] == passage and got[1]["n_removed"] == 0
    assert got[2]["n_removed"] >= 20 and len(got[2]["text"]) <= 14 and got[3]["n_removed"] == 0


def test_blank_lines_end_sentences():
    a = substring_dedup.runs("ein titel\n\n" + "wort " * 25 + "ende. " + "noch " * 3, SpanParams())
    assert 0 in a[1] and 2 in a[1]


def test_no_run_comes_twice():
    r = random.Random(5)
    for _ in range(50):
        text = " ".join(sentence(r.choice("abc"), r.randint(2, 30)) for _ in range(r.randint(1, 20)))
        _, s, n = substring_dedup.runs(text, SpanParams())
        assert len(np.unique(np.stack([s, n], axis=1), axis=0)) == len(s)


def test_very_long_text(spark):
    text = "Eins zwei drei vier. " * 200_000
    got = cut(spark, [(1, text), (2, "x" * 3_000_000 + " " + "\n" * 1_000_000)])
    assert got[1][1] > 700_000 and got[2] == (["x" * 3_000_000], 0)

"""Many phrases found in one pass over each text, by an Aho-Corasick automaton.

The automaton is built once in each Python worker from the phrases alone, so what is sent to the tasks is the phrase list;
its size is checked.  A text crosses to Python once, batch by batch, and a short list of numbers comes back: the phrases it
holds between word edges.  The cost of a text doesn't grow with the number of phrases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 64 << 20  # of all phrases


def canonical(phrase: str) -> str:
    return " ".join(phrase.lower().split())


@lru_cache(maxsize=16)
def _build(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        a.add_word(p, (i, len(p)))
    a.make_automaton()
    return a


def _edge(c: str) -> bool:
    return not (c.isalnum() or c == "_")


def found(text: str | None, phrases: tuple[str, ...]) -> list[int]:
    """Numbers of the phrases that a normalised text holds between word edges, rising."""
    if not text or not phrases:
        return []
    out, n = set(), len(text)
    for end, (i, size) in _build(phrases).iter(text):
        begin = end - size
        if (begin < 0 or _edge(text[begin])) and (end + 1 == n or _edge(text[end + 1])):
            out.add(i)
    return sorted(out)


class Phrases:
    """Which of many phrases a text, brought to the form that `fold` gives them, holds between word edges.  ValueError for phrases beyond MOST_BYTES."""

    def __init__(self, phrases: list[str], fold: Callable[[str], str] = canonical):
        self.fold = fold
        self.all = tuple(sorted({fold(p) for p in phrases} - {""}))
        if (size := sum(len(p.encode()) for p in self.all)) > MOST_BYTES:
            raise ValueError(f"{size} bytes of phrases are more than the {MOST_BYTES} that each worker may hold")
        self.number = {p: i for i, p in enumerate(self.all)}

    def prepare(self, t: Column) -> Column:
        """array<int> of a normalised text: the phrases' numbers.  A Python function: not for use within a lambda."""
        phrases = self.all

        @F.pandas_udf("array<int>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([found(x, phrases) for x in texts])

        return run(t)

    def has(self, x: Column, phrase: str) -> Column:
        return F.array_contains(x, F.lit(self.number[self.fold(phrase)]))


def phrase_votes(docs: DataFrame, key: str, text: str, dictionary: list[tuple[str, str, float]]) -> DataFrame:
    """key, code, points: what the phrases that a normalised text holds give each code, for (phrase, code, points) entries of any
    number.  The entries are looked up by phrase number in a table that Spark joins, not in an expression for each."""
    phrases = Phrases([p for p, _, _ in dictionary])
    entries = docs.sparkSession.createDataFrame([(phrases.number[canonical(p)], c, float(w)) for p, c, w in dictionary if canonical(p)], "__phrase int, code string, points double")
    hits = docs.select(key, F.explode(phrases.prepare(F.col(text))).alias("__phrase"))
    return hits.join(entries, "__phrase").groupBy(key, "code").agg(F.sum("points").alias("points"))

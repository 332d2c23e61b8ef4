"""Search analysis: tokens, word parts, synonyms, stems and edge n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import values as V


def search_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, with repeats."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def synonym_map() -> Column:
    """term -> first term of its synonym group, as a literal map."""
    return F.create_map(*[F.lit(x) for group in V.SYNONYMS for t in group for x in (t, group[0])])


def canonical(token: Column) -> Column:
    """The token's synonym group, or the token."""
    return F.coalesce(F.element_at(synonym_map(), token), token)


def edge_ngrams(token: Column, low: int = 3, high: int = 15) -> Column:
    n = F.least(F.length(token), F.lit(high))
    return F.when(n >= low, F.transform(F.sequence(F.lit(low), n), lambda i: F.substring(token, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


def has_phrase(words: Column, phrase: list[str]) -> Column:
    """Whether the words hold the phrase's words one after the other."""
    if not phrase:
        return F.lit(False)
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - len(phrase) + 1, F.lit(1)))
    want = F.array(*[F.lit(w) for w in phrase])
    return F.exists(at, lambda i: F.slice(words, i, len(phrase)) == want)


_VOWELS = "aeiou"


def _measure(stem: str) -> int:
    shape = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return sum(1 for i in range(1, len(shape)) if shape[i - 1 : i + 1] == "vc")


def _vowel(w: str, i: int) -> bool:
    return w[i] in _VOWELS or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _short(w: str) -> bool:
    return len(w) > 2 and not _vowel(w, len(w) - 3) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 1) and w[-1] not in "wxy"


#: Suffixes of the published Porter algorithm, longest of a step first where they overlap.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")


def porter(w: str) -> str:
    """The Porter stem of a lower-case ASCII word; other words unchanged."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for s, r in table:
            if w.endswith(s):
                w = w[: -len(s)] + r if _measure(w[: -len(s)]) > 0 else w
                break
    for s in _STEP4:
        if w.endswith(s):
            stem = w[: -len(s)]
            if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _stem_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(stem=b["token"].map(porter))


def stems(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, stem) of the distinct tokens: Python runs once per distinct token, never per occurrence."""
    return tokens.select(F.col(token).alias("token")).distinct().mapInPandas(_stem_batches, "token string, stem string")

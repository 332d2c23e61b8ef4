"""Scores of the search routes over an index table: slash commands, numbers, paths and plain terms.

A score is the sum of the boosts of the clauses that hold; rows without one go.  Keyword fields may be strings or arrays of
strings, whose elements are compared each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import values as V
from quire.functions.analysis import has_phrase, search_tokens
from quire.functions.text import let
from quire.operators.search import minimum_should_match, page_of, parse, phrase_search

CONTENT = ("main_content", "embedded_content", "ocr_content")
TAGS = ("category", "department", "purpose", "dynamic_subtags", "key_names", "location_mentioned", "important_dates", "confidentiality")
PATH_FIELDS = ("file_name", "file_path", "category", "department", "purpose", "file_type", "smart_id", "dynamic_subtags")
MOST_QUERY_CHARS = 5_000

#: The field of each list mode, and (exact, phrase, single token) boosts of each mode.
MODE_FIELDS = {"person": "key_names", "location": "location_mentioned", "date": "important_dates"}
MODE_BOOSTS = {m: (10, 5, 0) for m in MODE_FIELDS} | {"confidentiality": (10, 0, 0)} | {m: (20, 10, 5) for m in ("category", "department", "purpose")}


def words_of(q: str) -> list[str]:
    return re.findall(r"[^\W_]+", q.lower())


def _clause(hit: Column, boost: float) -> Column:
    return F.when(F.coalesce(hit, F.lit(False)), float(boost)).otherwise(0.0)


def _each(docs: DataFrame, field: str, test) -> Column:  # noqa: ANN001
    """Whether the test holds for the field or, of an array, for an element; false where the table lacks the field."""
    if field not in docs.columns:
        return F.lit(False)
    return F.exists(F.col(field), test) if isinstance(docs.schema[field].dataType, T.ArrayType) else test(F.col(field))


def _is(*values: str):  # noqa: ANN202
    return lambda c: c.isin(*values)


def _says(phrase: str):  # noqa: ANN202
    return lambda c: has_phrase(search_tokens(c), words_of(phrase))


def _scored(docs: DataFrame, clauses: list[Column]) -> DataFrame:
    return docs.withColumn("score", sum(clauses, F.lit(0.0))).where("score > 0")


def _variants(value: str) -> tuple[str, ...]:
    return tuple(sorted({value, value.lower(), value.title(), value.upper()}))


def _ext(docs: DataFrame, value: str) -> list[Column]:
    ext = value.lower().lstrip(".")
    return [_clause(_each(docs, "file_type", _is(ext)), 20), _clause(_each(docs, "mime_type", _is(V.EXT_TO_MIME.get(ext, ext))), 10), _clause(_each(docs, "file_name", lambda c: c.endswith("." + ext)), 5)]


def _uid(docs: DataFrame, value: str) -> list[Column]:
    return [_clause(_each(docs, "smart_id", _is(value)), 20), _clause(_each(docs, "smart_id", _says(value)), 5)]


def slash(docs: DataFrame, mode: str, value: str) -> DataFrame:
    """A slash command of the service: ids, extensions, or a tag in any case of its letters; all other modes are tags."""
    if mode == "uid":
        return _scored(docs, _uid(docs, value))
    if mode == "ext":
        return _scored(docs, _ext(docs, value))
    same = [_clause(_each(docs, f, _is(*_variants(value))), b) for f, b in (("category", 15), ("department", 15), ("purpose", 15), ("dynamic_subtags", 12))]
    said = [_clause(_each(docs, f, _says(value)), 5) for f in ("category", "department", "purpose")]
    more = []
    if "extended_metadata" in docs.columns:
        more.append(_clause(F.exists(F.map_values("extended_metadata"), lambda c: F.arrays_overlap(search_tokens(c), _literals(words_of(value)))), 10))
    return _scored(docs, same + said + more)


def strict_slash(docs: DataFrame, mode: str, value: str) -> DataFrame:
    """A slash command of the dashboard: never the contents, never embedded files; plain tags need a category."""
    if "is_embedded" in docs.columns:
        docs = docs.where(~F.coalesce(F.col("is_embedded"), F.lit(False)))
    if mode == "uid":
        return _scored(docs, _uid(docs, value))
    if mode == "ext":
        return _scored(docs, _ext(docs, value))
    if mode in MODE_BOOSTS:
        field, (exact, phrase, token) = MODE_FIELDS.get(mode, mode), MODE_BOOSTS[mode]
        clauses = [_clause(_each(docs, field, lambda c: F.lower(c) == value.lower()), exact)]
        if phrase:
            clauses.append(_clause(_each(docs, field, _is(value)), phrase))
        if token:
            clauses.append(_clause(_each(docs, field, lambda c: F.array_contains(search_tokens(c), value.lower())), token))
        return _scored(docs, clauses)
    clauses = [c for f in TAGS for c in (_clause(_each(docs, f, _is(*_variants(value))), 10), _clause(_each(docs, f, _is(value)), 5))]
    return _scored(docs.where(F.col("category").isNotNull()), clauses)


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def numeric(docs: DataFrame, q: str, boosts: dict[str, float]) -> DataFrame:
    """A number: a content that is just it counts ten times its boost, the number as a phrase once."""
    same = [_clause(F.col(f) == q, b * 10) for f, b in boosts.items() if f in CONTENT]
    return _scored(docs, same + [_clause(_each(docs, f, _says(q)), b) for f, b in boosts.items()])


def path(docs: DataFrame, q: str, boosts: dict[str, float]) -> DataFrame:
    """A path: the whole path 20, a part of it 10, its last part in the name 8, and as phrase or words in the tag fields;
    contents are left out.  The phrase may lack one word between its words."""
    last = re.split(r"[\\/]", q)[-1]
    clauses = [_clause(F.col("file_path") == q, 20), _clause(F.contains("file_path", F.lit(q)), 10)]
    if last:
        clauses.append(_clause(F.contains("file_name", F.lit(last)), 8))
    words = words_of(q)
    forms = 2 if "\\" in q else 1  # the form with slashes has the same words and counts again
    for f, b in boosts.items():
        if f in PATH_FIELDS:
            clauses.append(_clause(_each(docs, f, lambda c: let(search_tokens(c), lambda t: _near_phrase(t, words))), b * 2 * forms))
            clauses.append(_clause(_each(docs, f, lambda c: let(search_tokens(c), lambda t: F.size(F.array_intersect(t, _literals(words))) == len(set(words)))), b * forms))
    return _scored(docs, clauses)


def _near_phrase(tokens: Column, words: list[str]) -> Column:
    """Whether the tokens hold the words in order with one other token between two of them at most."""
    hit = has_phrase(tokens, words)
    for i in range(1, len(words)):
        hit = hit | _with_gap(tokens, words, i)
    return hit


def _with_gap(tokens: Column, words: list[str], i: int) -> Column:
    head, tail = _literals(words[:i]), _literals(words[i:])
    at = F.sequence(F.lit(1), F.greatest(F.size(tokens) - len(words), F.lit(1)))
    return F.exists(at, lambda p: (F.slice(tokens, p, i) == head) & (F.slice(tokens, p + i + 1, len(words) - i) == tail))


def synonyms(term: str) -> list[str]:
    """The term's synonym group, or the term alone."""
    return next((list(g) for g in V.SYNONYMS if term in g), [term])


def accurate(docs: DataFrame, q: str, boosts: dict[str, float], filters: dict | None = None, share: float = 0.75) -> DataFrame:
    """Plain terms: rows that hold, over all fields together, at least the floor of share x distinct terms or synonyms of
    them, under exact filters.  Each term gives the largest boost of a field that holds it, the whole query as a phrase
    twice the best field's, a term in the extended metadata 1.5.  Nested fields are left out; a query is cut at 5,000
    characters."""
    for c, v in (filters or {}).items():
        docs = docs.where(F.col(c).isin(*v) if isinstance(v, list | tuple) else F.col(c) == v)
    words = words_of(q[:MOST_QUERY_CHARS])
    terms, fields = list(dict.fromkeys(words)), {f: float(b) for f, b in boosts.items() if not f.startswith(("embedded_files", "metadata"))}
    if not terms:
        return docs.withColumn("score", F.lit(0.0)).limit(0)

    def judge(t: Column) -> Column:
        held = lambda w: F.greatest(*[F.when(F.arrays_overlap(t[f], _literals(synonyms(w))), b).otherwise(0.0) for f, b in fields.items()], F.lit(0.0))
        best = F.greatest(*[F.when(has_phrase(t[f], words), b * 2).otherwise(0.0) for f, b in fields.items()], F.lit(0.0))
        each = F.array(*[held(w) for w in terms])
        return let(each, lambda e: F.when(F.size(F.filter(e, lambda x: x > 0)) >= minimum_should_match(len(terms), share), F.aggregate(e, best, lambda a, x: a + x)))

    score = let(F.struct(*[search_tokens(F.col(f)).alias(f) for f in fields]), judge)
    if "extended_metadata" in docs.columns:
        score = score + _clause(F.exists(F.map_values("extended_metadata"), lambda c: F.arrays_overlap(search_tokens(c), _literals(terms))), 1.5)
    return docs.withColumn("score", score).where("score > 0")


def fragments(c: Column, terms: list[str], size: int, most: int) -> Column:
    """The `most` fragments with the most hits of terms of three letters or more, marked; of equals the first.  A fragment is as many
    whole words as `size` characters hold; only a word that is longer itself is cut."""
    long = [re.escape(t) for t in terms if len(t) >= 3]
    if not long:
        return F.array().cast("array<string>")
    pattern = f"(?i)({'|'.join(long)})"
    pieces = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(fragment_pattern(size)), F.lit(0)), lambda p: F.rtrim(F.translate(p, "\t\n\r", "   ")))
    counted = F.transform(pieces, lambda p, i: F.struct((-F.regexp_count(p, F.lit(pattern))).alias("n"), i.alias("i"), p.alias("p")))
    best = F.slice(F.array_sort(F.filter(counted, lambda x: x["n"] < 0)), 1, most)
    return F.transform(best, lambda x: F.regexp_replace(x["p"], pattern, "<mark>$1</mark>"))


def fragment_pattern(size: int) -> str:
    """Words up to `size` characters in all and the white space after them, or that many characters of a longer word."""
    return rf"(?s)\S(?:.{{0,{size - 2}}}\S)?(?:\s|$)|\S{{{size}}}"


def find(docs: DataFrame, q: str, boosts: dict[str, float], key: str = "id", filters: dict | None = None, exact: bool = False, strict: bool = True, page: int = 1, size: int = 10) -> DataFrame:
    """The router: a page of the scored rows of the route that the query tells (see parse), best first, equals by key.
    `strict` takes the dashboard's slash commands, else the service's.  A query without words finds nothing."""
    parsed = parse(q, exact)
    for c, v in (filters or {}).items():
        docs = docs.where(F.col(c).isin(*v) if isinstance(v, list | tuple) else F.col(c) == v)
    if parsed.mode == "slash":
        rows = (strict_slash if strict else slash)(docs, parsed.slash, parsed.value)
    elif parsed.mode == "phrase":
        rows = phrase_search(docs, boosts, parsed.value) if parsed.terms else docs.withColumn("score", F.lit(0.0)).where(F.lit(False))
    elif parsed.mode == "numeric":
        rows = numeric(docs, parsed.value, boosts)
    elif parsed.mode == "path":
        rows = path(docs, parsed.value, boosts)
    else:
        rows = accurate(docs, parsed.value, boosts)
    return page_of(rows, [F.col("score").desc(), F.col(key)], page, size)

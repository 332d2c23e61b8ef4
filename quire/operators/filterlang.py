"""The audit filter language: field:value terms with AND and OR, strictly from left to right."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'"[^"]*"|\S+')


@dataclass(frozen=True)
class Term:
    """field is None for a bare word; `how`: contains, equals or type."""

    field: str | None
    value: str
    how: str


def tokenize(q: str) -> list[str]:
    """Quoted strings or runs without white space (a quote inside a run doesn't hold it together)."""
    return _TOKEN.findall(q or "")


def parse(q: str, fields: dict[str, str]) -> list[tuple[str, Term]]:
    """(operator before, term) in order; the first operator is empty. ValueError for anything else."""
    out: list[tuple[str, Term]] = []
    pending: str | None = ""
    for token in tokenize(q):
        if token.upper() in ("AND", "OR"):
            if pending is not None:
                raise ValueError(f"operator without a term before it: {token}")
            pending = token.upper()
            continue
        out.append((pending if pending is not None else "AND", _term(token, fields)))
        pending = None
    if pending is not None and out:
        raise ValueError("operator without a term after it")
    if pending:
        raise ValueError("operator without terms")
    return out


def _term(token: str, fields: dict[str, str]) -> Term:
    if token.startswith('"') or ":" not in token:
        value = token.strip('"')
        if not value:
            raise ValueError("empty term")
        return Term(None, value, "contains")
    name, _, value = token.partition(":")
    name, value = name.strip().lower(), value.strip().strip('"')
    if name not in fields:
        raise ValueError(f"unknown field: {name}")
    if not value:
        raise ValueError(f"field without a value: {name}")
    return Term(name, value, "contains" if name in ("name", "path") else "type" if name == "type" else "equals")


def predicate(q: str, fields: dict[str, str], text_fields: list[str]) -> Column:
    """The filter as a Column over the mapped columns; true for an empty query."""
    like = lambda c, v: F.coalesce(F.col(c).cast("string").ilike(f"%{v}%"), F.lit(False))
    same = lambda c, v: F.coalesce(F.lower(F.col(c).cast("string")) == v.lower(), F.lit(False))

    def column(t: Term) -> Column:
        if t.field is None:
            return reduce(lambda a, b: a | b, (like(c, t.value) for c in text_fields))
        c = fields[t.field]
        if t.how == "contains":
            return like(c, t.value)
        if t.how == "type":
            bare = t.value.lstrip(".")
            return same(c, bare) | same(c, "." + bare)
        return same(c, t.value)

    out = F.lit(True)
    for op, term in parse(q, fields):
        out = column(term) if not op else out & column(term) if op == "AND" else out | column(term)
    return out


def sql_predicate(q: str, fields: dict[str, str], text_fields: list[str]) -> str:
    """The same filter as SQL text (DuckDB)."""
    esc = lambda v: v.replace("'", "''")

    def one(t: Term) -> str:
        if t.field is None:
            return "(" + " or ".join(f"coalesce({c}::varchar ilike '%{esc(t.value)}%', false)" for c in text_fields) + ")"
        c = fields[t.field]
        if t.how == "contains":
            return f"coalesce({c}::varchar ilike '%{esc(t.value)}%', false)"
        if t.how == "type":
            return f"coalesce(lower({c}::varchar) in ('{esc(t.value.lstrip('.').lower())}', '.{esc(t.value.lstrip('.').lower())}'), false)"
        return f"coalesce(lower({c}::varchar) = '{esc(t.value.lower())}', false)"

    out = "true"
    for op, term in parse(q, fields):
        out = one(term) if not op else f"({out} {op.lower()} {one(term)})"
    return out


def search(df: DataFrame, q: str, fields: dict[str, str], text_fields: list[str], order: str, limit: int) -> DataFrame:
    """Matching rows, newest first, between 1 and 1000 of them; an empty query is the live feed."""
    return df.where(predicate(q, fields, text_fields)).orderBy(F.col(order).desc()).limit(min(max(limit, 1), 1000))

"""All registered queries of the engine with their DuckDB oracles."""

from __future__ import annotations

from quire.plans import building, details, documents, keyed, lifecycle, queues, reports, routes, runs, search

_MODULES = (building, details, documents, keyed, lifecycle, queues, reports, routes, runs, search)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}

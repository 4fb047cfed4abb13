"""Registered queries of the engine's own operators, each with its SQL twin where SQL can say it.

The supplied tables stand in for the domain's: orders are run items, market segments models,
priorities purposes, line status modes, return flags metrics; conversations are responses,
embeddings chunk vectors, events job events, documents and pages sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, or another."""

    def keep(f):
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from lectern import queries_analytics, queries_composites, queries_documents, queries_events, queries_relational  # noqa: F401

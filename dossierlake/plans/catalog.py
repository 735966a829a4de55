"""Registry of named queries: each has a Spark form and, where SQL can express it, a DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows."""

    def put(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return put


def _load() -> None:
    from . import answer_queries, dossier_queries, extraction_queries, gate_queries, ledger_queries, memo_queries, ops_queries, profile_queries, retrieval_queries, stored_queries, text_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)

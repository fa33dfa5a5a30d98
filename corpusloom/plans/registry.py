"""All core queries by name, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from corpusloom.plans import core_queries, core_sql, document_queries, document_sql

FLAGSHIP = "hybrid_retrieval"


def queries() -> dict[str, Callable]:
    return core_queries.queries() | document_queries.queries()


def oracle_sql() -> dict[str, str]:
    return core_sql.core_oracle_sql() | document_sql.oracle_sql()

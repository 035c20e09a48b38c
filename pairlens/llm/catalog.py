"""All queries of the training-data subpackage, and their SQL checks."""

from __future__ import annotations

from pairlens.llm import record_queries, split_queries, text_queries, vector_queries

MODULES = (record_queries, split_queries, text_queries, vector_queries)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}

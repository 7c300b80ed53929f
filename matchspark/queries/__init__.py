"""Registered queries and, where SQL can express them, their twin in plain SQL."""

from matchspark.queries.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

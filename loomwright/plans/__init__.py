"""Queries built from the operators, with the SQL that DuckDB holds them against."""

from .registry import flagship, oracle_sql, queries

__all__ = ["flagship", "oracle_sql", "queries"]

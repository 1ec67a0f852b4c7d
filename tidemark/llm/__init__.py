"""Operators for large-scale training-data pipelines. Nothing else in the library imports this."""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

"""Registered queries and their SQL twins over the driver's tables."""

from .catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]

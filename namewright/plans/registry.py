"""Queries and their SQL, by name."""

from __future__ import annotations

from . import oracle, pool_queries, queries

QUERIES = {**queries.QUERIES, **pool_queries.QUERIES}
ORACLE_SQL = {**oracle.ORACLE_SQL, **pool_queries.ORACLE_SQL}

__all__ = ["ORACLE_SQL", "QUERIES"]

"""The queries over the given tables, and their SQL."""

from __future__ import annotations

from archlens.plans import block_queries, oracles, queries

QUERIES = queries.QUERIES | block_queries.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | block_queries.ORACLE_SQL
FLAGSHIP = QUERIES["count_by_law"]
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

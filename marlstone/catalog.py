"""Queries of the knowledge-base engine and their SQL oracles."""

from __future__ import annotations

from .plans import content_queries, metadata_queries

QUERIES: dict = {**metadata_queries.QUERIES, **content_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**metadata_queries.ORACLE_SQL, **content_queries.ORACLE_SQL}

"""All queries over the input tables, by name, and their SQL."""

from __future__ import annotations

from tessera.plans import chat_queries, graph_queries, ingest_queries, search_queries, text_queries

_PARTS = (search_queries, graph_queries, text_queries, chat_queries, ingest_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}

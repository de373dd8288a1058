"""All queries of the subpackage with their SQL."""

from __future__ import annotations

from foliant.llm import chunk_queries, document_queries, ranking_queries, source_queries, text_queries, vector_queries

_PARTS = (ranking_queries, chunk_queries, document_queries, vector_queries, text_queries, source_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}

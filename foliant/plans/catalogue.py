"""All queries of the core with their SQL."""

from __future__ import annotations

from foliant.plans import hygiene, incremental, retrieval, upkeep

_PARTS = (incremental, retrieval, hygiene, upkeep)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
FLAGSHIP = "bm25_project_cap"

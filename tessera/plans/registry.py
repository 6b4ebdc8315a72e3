"""All registered queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from . import align_queries, fusion_queries, graph_queries, more_queries, rag_queries, relational_queries, resolve_queries, scalar_queries, search_queries, text_queries

_PARTS = (search_queries, graph_queries, relational_queries, align_queries, text_queries, more_queries, scalar_queries, fusion_queries, resolve_queries, rag_queries)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
FLAGSHIP = "hybrid_search"

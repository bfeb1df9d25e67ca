"""All queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from fathomweave.plans import builder_queries, graph_queries, relation_queries, text_queries, vector_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (vector_queries, text_queries, relation_queries, graph_queries, builder_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL

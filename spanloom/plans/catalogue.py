"""All queries of the engine outside the corpus operators, by name, and SQL for DuckDB."""

from __future__ import annotations

from . import answer_queries, evidence_queries, graph_queries, order_queries, row_queries, set_queries, span_queries

QUERIES, SQL = {}, {}
for module in (span_queries, set_queries, graph_queries, row_queries, answer_queries, evidence_queries, order_queries):
    QUERIES |= module.QUERIES
    SQL |= module.SQL

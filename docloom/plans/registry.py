"""Registry of the corpus queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from . import corpus_queries, language_queries, narrative_queries, planted_queries, report_queries, store_queries, table_queries, text_queries

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (text_queries, language_queries, corpus_queries, planted_queries, report_queries, narrative_queries, store_queries, table_queries):
    QUERIES.update(module.QUERIES)
    ORACLE_SQL.update(module.SQL)

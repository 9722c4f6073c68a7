"""All queries outside the llm subpackage, by name, and their SQL."""

from __future__ import annotations

from talweg.plans import match_queries, parse_queries, stat_queries, table_queries

_MODULES = (table_queries, stat_queries, match_queries, parse_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

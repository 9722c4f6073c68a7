"""Queries of the llm operators by name, and their SQL where there is any."""

from __future__ import annotations

from talweg.llm import corpus_queries, data_queries, text_queries

_MODULES = (text_queries, corpus_queries, data_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

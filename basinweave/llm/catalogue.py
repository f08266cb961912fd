"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from basinweave.llm import queries_files, queries_leakage, queries_names, queries_pages, queries_tokens, queries_values

_MODULES = (queries_values, queries_files, queries_names, queries_tokens, queries_leakage, queries_names, queries_pages)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

"""All queries of the library proper and their SQL."""

from __future__ import annotations

from basinweave.plans import content_queries, core_problems, graph_queries, lens_queries, recompose_queries, stream_queries

_MODULES = (graph_queries, lens_queries, content_queries, recompose_queries, stream_queries, core_problems)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import candidate_queries, caption_queries, fold_queries, geometry_queries, registry_queries, series_queries, sound_queries

_MODULES = (candidate_queries, caption_queries, fold_queries, geometry_queries, registry_queries, series_queries, sound_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}

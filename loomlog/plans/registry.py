"""All named queries of the log operators, with their SQL twins."""

from __future__ import annotations

from loomlog.plans import catalog_queries, event_queries, log_queries, metric_queries, source_queries, text_queries

_MODULES = (log_queries, catalog_queries, event_queries, source_queries, text_queries, metric_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}

"""All queries of the core and their SQL counterparts, gathered from the plan modules."""

from __future__ import annotations

from cartulary.plans import archive_queries, file_queries, orphan_queries, page_queries, reader_queries, relational_queries, scalar_queries, site_queries, stream_queries

_MODULES = [orphan_queries, scalar_queries, reader_queries, page_queries, archive_queries, file_queries, site_queries, relational_queries, stream_queries]


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}

"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from cartulary.llm import canonical_queries, card_queries, packing_queries, pair_queries, personal_queries, span_queries, token_queries

_MODULES = [pair_queries, card_queries, personal_queries, canonical_queries, token_queries, packing_queries, span_queries]


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}

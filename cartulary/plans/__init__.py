"""Queries, each beside its SQL counterpart."""

"""Registered queries and their DuckDB twins."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(queries, oracles) of this package."""
    from . import analytics, base, packers, related, retrieving, scoring, searching, streams, texts  # noqa: F401  registering them
    from .registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)

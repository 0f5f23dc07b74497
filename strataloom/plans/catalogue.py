"""Catalogue of queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from . import graph_queries, log_queries, replay_queries, search_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries and their SQL, by operator family."""

from __future__ import annotations

from .base import ORACLE, QUERIES, flagship
from . import aggregates, geometry, joins, library, projections, ranking, sequences, sets, sources, statistics, streams, vectors, windows  # noqa: F401

__all__ = ["ORACLE", "QUERIES", "flagship"]

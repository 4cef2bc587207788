"""Queries and their DuckDB equivalents, by name."""

from __future__ import annotations

from offerlens.plans import discovery, offers, pages, registry, views

_modules = (offers, pages, registry, discovery, views)
QUERIES: dict = {k: v for m in _modules for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _modules for k, v in m.ORACLE_SQL.items()}

"""All queries of the subpackage, by name, and their SQL where there is any."""

from __future__ import annotations

from . import consistent_queries, language_queries, leaks_queries, linkage_queries, mixing_queries, near_queries, splitting_queries

_MODULES = [consistent_queries, language_queries, leaks_queries, linkage_queries, mixing_queries, near_queries, splitting_queries]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}

"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from . import answer_queries, build_queries, corpus_queries, entity_queries, evidence_queries, fact_queries, graph_queries, intake_queries, locate_queries, manifest_queries, orphan_queries, planning_queries, rank_queries, reading_queries, score_queries, select_queries, shortlist_queries, strategy_queries

_MODULES = [orphan_queries, rank_queries, corpus_queries, entity_queries, select_queries, strategy_queries, evidence_queries, reading_queries, answer_queries, graph_queries, score_queries, manifest_queries, planning_queries, locate_queries, shortlist_queries, fact_queries, build_queries, intake_queries]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
FLAGSHIP = "bm25_topk"

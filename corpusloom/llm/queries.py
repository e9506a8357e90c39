"""Queries of this subpackage, with their SQL where SQL can express them."""

from corpusloom.llm import language_queries, leakage_queries, near_duplicate_queries, neighbour_queries, packing_queries, reading_level_queries, scan_queries, sentence_queries, splitting_queries

_MODULES = [near_duplicate_queries, scan_queries, neighbour_queries, leakage_queries, language_queries, reading_level_queries, sentence_queries, splitting_queries, packing_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}

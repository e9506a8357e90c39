"""Queries registered for the driver, with their SQL."""

from corpusloom.plans import chat, chunking, collection, delivery, dialog, search, streaming, telemetry, text

_MODULES = [delivery, text, search, chunking, dialog, chat, telemetry, collection, streaming]
FLAGSHIP = "hybrid_search"


def all_queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def all_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

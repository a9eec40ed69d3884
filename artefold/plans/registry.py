"""All queries of the library and their SQL, from the modules of this package."""

from __future__ import annotations

from artefold.plans import broker_queries, context_queries, coverage_queries, native_queries, p_queries, packet_queries, source_queries, text_queries

MODULES = (p_queries, coverage_queries, text_queries, context_queries, native_queries, broker_queries, packet_queries, source_queries)


#: Operators that users add: name -> function of (session, folder), like all queries here.
ADDED: dict = {}


def register(name: str, run) -> None:
    """Add a reducer or query under a name; it is then part of ``queries()``."""
    if name in queries():
        raise ValueError(f"{name} is taken")
    ADDED[name] = run


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()} | ADDED


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}

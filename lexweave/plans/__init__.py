"""Registered queries of the engine, by topic."""

from __future__ import annotations

from importlib import import_module

TOPICS = ("search_queries", "version_queries", "corpus_queries", "import_queries", "reader_queries")


def all_queries() -> tuple[dict, dict]:
    """Queries and SQL of all topics."""
    found, oracle = {}, {}
    for topic in TOPICS:
        module = import_module(f"lexweave.plans.{topic}")
        found |= module.QUERIES
        oracle |= module.ORACLE
    return found, oracle

"""The driver's queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and SQL, in the order in which their queries are registered.
MODULES = ("records", "joins", "scores", "library", "ions", "inputs", "pipelines")


def collect() -> tuple[dict, dict]:
    """All queries of the core and their SQL."""
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"spectrail.catalog.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql

"""All registered queries and their SQL."""

from __future__ import annotations

from lumbre.plans import cadences, programs, runlog, statistics, streams

MODULES = (statistics, programs, runlog, cadences, streams)


def all_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}

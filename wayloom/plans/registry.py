"""All queries of the core, with the SQL of those that SQL can express."""

from __future__ import annotations

from wayloom.plans import data_queries, graph_queries, street_queries


def queries() -> dict:
    return graph_queries.Q | street_queries.Q | data_queries.QUERIES


def oracles() -> dict[str, str]:
    return graph_queries.SQL | street_queries.SQL | data_queries.ORACLES

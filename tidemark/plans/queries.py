"""All registered queries on the driver's tables."""

from __future__ import annotations

from tidemark.plans import evidence_queries, gate_queries, grounding_queries, interval_queries, point_queries, rule_queries, selection_queries, series_queries, text_queries

ALL = {**interval_queries.QUERIES, **series_queries.QUERIES, **selection_queries.QUERIES, **text_queries.QUERIES, **evidence_queries.QUERIES, **point_queries.QUERIES, **rule_queries.QUERIES, **gate_queries.QUERIES, **grounding_queries.QUERIES}


def queries() -> dict:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in ALL.items() if sql}

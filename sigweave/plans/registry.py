"""All registered queries of the core and their SQL."""

from __future__ import annotations

from . import data_queries, long_queries, pipeline_queries, reference_queries, source_queries

MODULES = (reference_queries, pipeline_queries, long_queries, source_queries, data_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v.strip() for m in MODULES for k, v in m.SQL.items()}

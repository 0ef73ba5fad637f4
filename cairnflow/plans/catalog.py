"""All queries of the core and the SQL that each is held against."""

from __future__ import annotations

from cairnflow.plans import analytics_queries, cluster_queries, corpus_queries, evaluation_queries, event_queries, example_queries, function_queries, lifecycle_queries, pattern_queries, problem_queries, record_queries, retrieval_queries, store_queries, tool_queries

_MODULES = [problem_queries, retrieval_queries, store_queries, lifecycle_queries, pattern_queries, record_queries, analytics_queries, cluster_queries, event_queries, corpus_queries, example_queries, evaluation_queries, tool_queries, function_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}

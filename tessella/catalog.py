"""All queries of the engine proper, by name, with their SQL."""

from __future__ import annotations

from tessella.plans import batch_queries, curriculum_queries, group_queries, metric_queries, registry, sink_queries, text_queries  # noqa: F401
from tessella.plans.curriculum_queries import flagship  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)

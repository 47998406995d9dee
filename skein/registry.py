"""The registered queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import audit_queries, label_queries, lift_queries, model_queries, pair_queries, queue_queries, resolve_queries

_MODULES = (pair_queries, label_queries, audit_queries, resolve_queries, lift_queries, queue_queries, model_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in m.SQL.items()}

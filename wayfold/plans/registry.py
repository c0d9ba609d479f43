"""Collects the registered queries and their SQL from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from wayfold.plans import geometry_queries, integrity_queries, match_queries, metric_queries

    return [geometry_queries, match_queries, metric_queries, integrity_queries]


def queries() -> dict[str, Query]:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLE_SQL.items()}

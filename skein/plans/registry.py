"""All queries of the engine's own operators, with the SQL that states the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("graph_queries", "relational_queries", "search_queries", "state_queries", "analysis_queries", "community_queries", "store_queries", "resolution_queries", "subgraph_queries")


def _modules():
    return [importlib.import_module(f"skein.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}

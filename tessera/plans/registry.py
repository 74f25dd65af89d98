"""Named queries of the library over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: The query that ``entry`` runs.
FLAGSHIP = "topic_year_trend"

#: Modules of queries, each with QUERIES and ORACLES.
MODULES = ("window_queries", "relational_queries", "text_queries", "model_queries", "planning_queries", "classify_queries", "analytics_queries", "horizon_queries", "assessment_queries")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tessera.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

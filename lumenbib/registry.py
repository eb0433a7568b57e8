"""All core queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, clustering, entities, forecasts, maintenance, nested, relational, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _plan in (nested, relational, analytics, clustering, entities, maintenance, forecasts, streams):
    QUERIES |= _plan.QUERIES
    SQL |= _plan.SQL

"""All queries of the package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import driver_queries, record_queries, rule_queries, value_queries

_PARTS = (driver_queries, rule_queries, record_queries, value_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for p in _PARTS for k, q in p.QUERIES.items()}
SQL: dict[str, str] = {k: s for p in _PARTS for k, s in p.SQL.items()}

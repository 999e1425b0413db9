"""All queries of the analytics operators, by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelane.plans import intake_queries, relation_queries, request_queries, series_queries, value_queries

FAMILIES = (intake_queries, request_queries, relation_queries, series_queries, value_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for f in FAMILIES for k, v in f.Q.items()}
ORACLE_SQL: dict[str, str] = {k: v for f in FAMILIES for k, v in f.SQL.items()}

"""Registered queries over the given tables, and SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafscan.plans import document_queries, record_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = document_queries.QUERIES | record_queries.QUERIES
ORACLE_SQL: dict[str, str] = document_queries.ORACLE_SQL | record_queries.ORACLE_SQL

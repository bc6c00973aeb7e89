"""Registered queries over whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import reference_queries, retrieval_queries, store_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return reference_queries.queries() | retrieval_queries.queries() | store_queries.queries()


def oracle_sql() -> dict[str, str]:
    return reference_queries.oracle_sql() | retrieval_queries.oracle_sql() | store_queries.oracle_sql()

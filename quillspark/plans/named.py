"""Named queries: each is a function of (spark, folder of tables), with SQL of the same rows where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def named(name: str, sql: str | None = None) -> Callable:
    def add(query: Callable) -> Callable:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add

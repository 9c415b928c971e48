"""Queries by name, each with the SQL of the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.sources.tables import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function from ``Tables`` to a DataFrame under ``name``."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql:
            SQL[name] = with_ctes(sql)
        return plan

    return register


def load() -> None:
    """Import every module that registers queries."""
    from tesserae.plans import basics, entities, landing, rollups, search, streams, texts, writes  # noqa: F401

"""Registered queries: each names an operator, the tables it reads, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL where SQL can say it."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def load() -> None:
    """Imports all modules of queries."""
    from lodestrata.plans import code, graphs, inventory, operations, retrieval, temporal, upkeep  # noqa: F401

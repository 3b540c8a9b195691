"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rallyframe.plans.bind import SQL_BASE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Register a query under its function's name, with the SQL that says the same (behind the relations of ``SQL_BASE``)."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (SQL_BASE if base else "") + sql
        return f

    return add

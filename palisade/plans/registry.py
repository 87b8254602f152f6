"""The named queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL for the same rows if there is one."""

    def f(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[make.__name__] = make
        if sql is not None:
            ORACLE_SQL[make.__name__] = sql
        return make

    return f

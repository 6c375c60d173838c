"""Where query modules enter what they offer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(body: str | None = None, *views: str):
    """Register a function (spark, sf_dir) by its name, with SQL over the named views."""

    def enter(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if body:
            ORACLE_SQL[f.__name__] = sql(body, *views)
        return f

    return enter

"""Where queries and the SQL that says the same are collected."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources import staging

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a callable of (spark, sf_dir), with DuckDB SQL where SQL can say the same."""

    def keep(function):
        @functools.wraps(function)
        def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
            with staging.scope():
                return function(spark, sf_dir)

        QUERIES[name] = scoped
        if sql:
            SQL[name] = sql
        return function

    return keep

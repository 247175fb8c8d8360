"""The catalogue of queries and of the SQL that each must agree with.

A module registers its queries with `query(name, sql)`; the function gets a table reader and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import Session
from ..sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Reads tables by attribute: t.orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return load_table(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    def registered(make: Callable[[Tables], DataFrame]):
        @wraps(make)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(Tables(Session(spark).spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return registered


from . import collections, functions, logs, relational, statements, streams  # noqa: E402, F401, I001

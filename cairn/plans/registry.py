"""Registered queries over the driver tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver tables of one folder as attributes; reading is lazy, so a query scans the columns that it uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Register a function of Tables as a query, with its SQL where there is one."""

    def wrap(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return f

    return wrap


# the modules register their queries when they are imported
from cairn.plans import catalog_queries, check_queries, decode_queries, graph_queries, legacy_queries, lookup_queries, matcher_queries, more_queries, review_queries, rule_queries, store_queries, summary  # noqa: E402, F401

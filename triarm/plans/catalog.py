"""Queries by name, each next to the SQL that must give the same rows."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None, also: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under ``name``, and under an earlier name that it goes on having."""
    def add(run):
        for known in filter(None, (name, also)):
            if known in CATALOG:
                raise ValueError(f"two queries are called {known}")
            CATALOG[known] = Query(run, sql)
        return run
    return add

"""Operators a training-data pipeline needs. Nothing else in the library imports them."""

import importlib

from triarm.plans.catalog import Query

CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under ``name``, next to its SQL check if there is one."""
    def add(run):
        if name in CATALOG:
            raise ValueError(f"two queries are called {name}")
        CATALOG[name] = Query(run, sql)
        return run
    return add


def llm_queries() -> dict[str, Query]:
    for module in ("queries", "queries_select"):
        importlib.import_module(f"triarm.llm.{module}")
    return CATALOG

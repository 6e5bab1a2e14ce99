"""Every query by its operator's ID, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries when they are imported.
MODULES: tuple[str, ...] = ("tidemark.plans.frozen_queries", "tidemark.plans.rowlocal_queries", "tidemark.plans.stats_queries", "tidemark.plans.shape_queries", "tidemark.plans.ensemble_queries", "tidemark.plans.model_queries", "tidemark.plans.source_queries")


def register(name: str, sql: str | None = None):
    """Decorator: the function (spark, sf_dir) -> DataFrame becomes the query `name`."""

    def put(f):
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    import importlib

    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

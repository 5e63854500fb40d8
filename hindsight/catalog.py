"""Registered queries and their SQL. Each module of ``queries`` registers its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with the DuckDB SQL that gives the same rows."""

    def keep(f):
        if name in _QUERIES:
            raise ValueError(f"a query named {name} is registered already")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def _load() -> None:
    from .queries import allarms, analysis, arms, calibration, evaluation, fields, fullarms, generators, graphs, growth, ledgers, ranking, tables  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

"""Collects queries: a function of Views with the equivalent SQL over the same stand-in views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixture_views import Views, with_views

QUERIES: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def register(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in QUERIES.items() if sql}
